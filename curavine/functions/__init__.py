"""Column functions: text, URLs, hashes, scores, metadata, images."""
