"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage; it can be deleted as a
whole.  ``queries.py`` registers the thin ``opN_<name>`` queries.
"""
