"""Millrace: ledger, corpus, retrieval, graph and session analytics as plain DataFrame functions."""
