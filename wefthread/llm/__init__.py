"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it: the engine works with the whole
folder deleted.
"""
