"""Ledger linkage, reconciliation and analytics on Spark."""
