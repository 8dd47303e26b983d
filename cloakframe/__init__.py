"""Spark-native anonymisation: partition, generalise, measure and attack releases."""

__version__ = "0.1.0"
