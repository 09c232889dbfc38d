"""Spark-native audit of captured websites, and operators for the text they hold."""
