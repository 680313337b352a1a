"""Whole jobs: scoring plans and the registered queries with their SQL checks."""
