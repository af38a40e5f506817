"""Readers and writers: aggregate documents, ledger tables, address feeds, dimensions."""
