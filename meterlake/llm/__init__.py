"""Operators for preparing language-model training data at scale.

Nothing outside this folder imports it; delete it and the rest still works.
"""
