"""Sources: ledger-shaped views of stored tables."""
