"""Ordered-ledger pattern analytics on PySpark."""
