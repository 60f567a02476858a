"""Ledger analytics on Spark: transactions, balances, categories, risk and document fields."""
