"""Classifiers as Spark jobs."""
