"""Operators for large training-data pipelines (one module per operator).

Nothing else in the library imports this subpackage; its queries are in
``queries.py`` and reach the driver through ``__spark_entry__.py``.
"""
