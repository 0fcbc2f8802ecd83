"""Humid-heat and location analytics on Spark."""
