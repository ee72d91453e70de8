"""Ridgeline: kernel learning and text analytics as Spark DataFrame operators."""
