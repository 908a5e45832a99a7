"""Readers, writers and the cohorts built on the test tables."""
