"""Text sources and sinks for graphs, queries and results."""
