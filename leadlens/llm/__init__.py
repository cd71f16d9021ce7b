"""Operators for preparing language-model training text at corpus scale.

One module per operator; each has a general interface, and a thin ``op<N>_*``
query in :mod:`leadlens.llm.registry` derives the contract's columns from it.
Nothing outside this subpackage imports it.
"""
