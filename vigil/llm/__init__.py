"""Training-data operators: one module per operator, queries in ``queries``.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it."""
