"""Household-bill analytics on Spark, with the provenance of every value kept."""
