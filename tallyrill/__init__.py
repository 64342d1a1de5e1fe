"""A Spark-first engine for tabular audits, entity conformance, web extraction and corpus work."""
