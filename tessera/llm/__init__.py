"""Training-data operators: deduplication, language ID, mixing, sharding, search, WARC and language-model scoring.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
