"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when it can be imported.
"""
