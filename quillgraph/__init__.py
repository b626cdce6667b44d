"""quillgraph: a Spark-first code-intelligence and retrieval-analytics engine."""
