"""Registered queries, by family, each with its SQL for the oracle."""
