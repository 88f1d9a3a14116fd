"""Operators for preparing training text.

Each module holds one operator; ``queries`` registers the thin ``opN_<name>``
queries.  Nothing outside this subpackage imports it.
"""
