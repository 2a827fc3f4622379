"""quillgraph: code-knowledge-graph analytics as Spark DataFrame plans."""
