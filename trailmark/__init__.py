"""Behaviour analytics on Spark: every question is a function from DataFrame to DataFrame."""
