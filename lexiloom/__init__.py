"""Stylometric text analytics as Spark DataFrame operators."""
