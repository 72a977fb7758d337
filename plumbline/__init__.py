"""plumbline: audit labelled tables and evaluate binary classifiers on Spark."""
