"""Operators for preparing text corpora: encoding, leakage, matching, scoring and labelling.

Nothing outside this subpackage imports it.
"""
