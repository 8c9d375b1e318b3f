"""Operators for preparing language-model training data at scale.

Each module holds one operator with a general interface and, at its end, the
thin query that applies it to the ``documents`` table.  ``registry`` gathers
the queries; nothing outside this subpackage imports it.
"""
