"""Operators for preparing language-model training data at cluster scale.

Nothing else in the library imports this subpackage.  ``catalogue`` lists the
registered queries and the SQL they can be compared with.
"""
