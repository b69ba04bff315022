"""Runnable jobs, test adapters, and the registered queries with their SQL."""
