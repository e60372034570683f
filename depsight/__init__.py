"""Dependency-risk analytics on Spark."""
