"""Operators over versions, logs, transactions and traces."""
