"""Operators that prepare training corpora for language models.

One module per operator; ``queries.py`` binds them to the test tables.
Nothing outside this subpackage imports it.
"""
