"""Preparing training data: packing, mixing, rendering, near and exact duplicates, filters, classifiers."""
