"""Wardline: message and link threat analytics as Spark DataFrame operators."""
