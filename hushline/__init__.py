"""Hushline: two-microphone acoustic anomaly analytics as Spark jobs."""
