"""Samples, relationship, variance components, scans and predictions."""
