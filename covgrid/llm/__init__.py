"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers one query per operator over the whole tables.
"""
