"""Relational and numeric operators on cohorts."""
