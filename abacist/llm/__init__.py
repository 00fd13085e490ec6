"""Operators for language-model training corpora: scoring, cleaning, deduplication, packing.

Every operator takes DataFrames and returns DataFrames. A document is a row with
``doc_id`` and ``text``; a NULL text is an empty one, other columns are carried
where an operator returns documents and ignored where it returns figures.
"""
