"""Operators for large text corpora meant for model training.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
