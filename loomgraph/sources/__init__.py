"""sources of the code-graph engine."""
