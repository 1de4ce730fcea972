"""strataweave: document-graph analytics on Spark."""
