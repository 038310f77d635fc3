"""Document curation and faceted search on Spark DataFrames."""
