"""Transcript analytics on PySpark: ledgers, rules, scoring, archives and retrieval over many sessions at once."""
