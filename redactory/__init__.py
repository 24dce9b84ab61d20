"""Sensitive-data analytics on Spark: rules, detectors, findings, routing."""
