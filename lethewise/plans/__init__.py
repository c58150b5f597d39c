"""Metric plans: named metrics, their dependencies, and how they are run."""
