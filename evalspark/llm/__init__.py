"""Operators for preparing language-model training data.

Each module holds one operator with a general interface and the thin
registered query that applies it to the driver tables.  Nothing outside this
subpackage imports it; ``__spark_entry__.py`` adds its queries when present.
"""
