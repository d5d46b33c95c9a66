"""Readers, writers and the domain views over the benchmark tables."""
