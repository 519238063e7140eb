"""streaming of the code-graph engine."""
