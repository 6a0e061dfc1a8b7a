"""Issue-triage analytics on Spark: ingest, audit, deduplicate, split, featurize, fit, score."""
