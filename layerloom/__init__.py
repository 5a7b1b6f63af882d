"""Transcript layering jobs on Spark."""
