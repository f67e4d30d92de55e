"""Registered queries: each operator on the given tables, next to plain SQL for it."""
