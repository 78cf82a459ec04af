"""Operators for training-data pipelines; their registered queries are in ``queries``.

Nothing else in the library imports this subpackage.
"""
