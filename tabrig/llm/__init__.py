"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; its queries are listed in
``queries.py`` and picked up by ``__spark_entry__.py`` when it is installed.
"""
