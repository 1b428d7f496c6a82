"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; ``entry`` holds the thin ``opN_*`` queries.
"""
