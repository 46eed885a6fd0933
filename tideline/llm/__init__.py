"""Operators for preparing large text collections for model training.

Nothing else in the library imports this subpackage.
"""
