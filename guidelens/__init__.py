"""Amplicon editing analytics on Spark."""
