"""Interval and position analytics as lazy Spark DataFrame operators."""
