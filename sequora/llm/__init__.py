"""Operators for building training corpora; each module holds one operator.

Nothing outside this subpackage imports it.  All operators read the columns they name and no others, so extra
columns, whatever they are called, neither reach a result nor clash with one.  A null text counts as empty unless a
docstring says otherwise, and repeated rows are kept as rows of their own.
"""
