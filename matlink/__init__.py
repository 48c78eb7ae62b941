"""Harmonisation of material master data across organisations on Spark."""
