"""siftstone: profile, clean, check and summarise very large tables with Spark."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
