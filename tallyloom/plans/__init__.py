"""Derived views, the registered queries and their SQL oracles."""
