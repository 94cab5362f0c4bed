"""Relational operators: joins, orderings, panel draw, ledger, audits."""
