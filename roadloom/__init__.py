"""Shortest-path analytics on hierarchical networks, written as Spark jobs."""
