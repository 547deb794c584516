"""Incremental work: fingerprints and debounced events."""
