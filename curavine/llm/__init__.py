"""Training-data operators: deduplication, tokens, scoring, packing, language, chat, HTML, secrets, search and tries.

Nothing else in the library imports this subpackage.
"""
