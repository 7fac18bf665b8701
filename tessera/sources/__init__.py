"""Catalog, committed versions on shared storage, and the transaction log."""
