"""Operators for preparing language-model training corpora.

Nothing else in ``pagemill`` imports this subpackage. Each module holds one
operator with a general interface and a thin ``query(spark, sf_dir)``.
"""
