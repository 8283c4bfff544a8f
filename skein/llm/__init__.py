"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; the entry module registers its
queries only when the subpackage is present.
"""
