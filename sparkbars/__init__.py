"""Spark-native analytics over ordered price/volume bars."""
