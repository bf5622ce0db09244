"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; the entry file adds its
queries when it can be imported.
"""
