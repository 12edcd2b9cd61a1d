"""Wayfare: a PySpark-native engine for time- and place-bound event records."""
