"""plans of the code-graph engine."""
