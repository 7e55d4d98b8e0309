"""Preference-ranking and acquisition analytics as PySpark DataFrame jobs."""
