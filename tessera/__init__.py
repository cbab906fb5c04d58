"""Tessera: statistics, learning and graph analytics as Spark jobs."""
