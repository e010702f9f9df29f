"""Training-data operators: corpus clean-up, near-duplicates, tokenising, packing.

Nothing else in the package imports this subpackage.  Queries live in
``paritas.llm.queries``; the five-stage pipeline in ``corpus_pipeline``.
"""
