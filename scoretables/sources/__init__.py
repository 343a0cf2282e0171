"""Readers, writers and the views that stand in for score data on the driver's tables."""
