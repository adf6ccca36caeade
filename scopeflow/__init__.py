"""Sensitive-data flow analytics on Spark."""
