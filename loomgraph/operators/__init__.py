"""operators of the code-graph engine."""
