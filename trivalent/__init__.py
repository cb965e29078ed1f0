"""trivalent: finite-graph and certificate analytics as Spark DataFrame programs."""
