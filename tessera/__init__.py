"""Tessera: analytics for content, engagement, procurement and training text on Spark."""
