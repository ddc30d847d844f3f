"""Operators for preparing training data at large scale.

Nothing outside this subpackage imports it.
"""
