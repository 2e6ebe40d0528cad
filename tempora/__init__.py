"""Tempora: history, drift and review analytics over repeated snapshots, on Spark."""
