"""loomgraph: a code-graph and corpus analytics engine expressed as Spark plans."""
