"""Operators for training-data pipelines: dedup, packing, joins, classifiers, tokens, shards.

Self-contained: nothing else in the library imports this subpackage.  Conventions shared by all
operators: rows are read from ``doc_id`` and ``text`` (other columns, whatever their names, are
ignored or passed through untouched), a null text is the empty text unless the operator says
otherwise, and intermediate tables go to the folder named by ``spark.checkpoint.dir``.
"""
