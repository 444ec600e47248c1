"""Suspicious-posting analytics as Spark DataFrame operators."""
