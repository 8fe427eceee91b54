"""Kairoflow: temporal sequence analytics expressed as Spark DataFrame plans."""
