"""tracefold: directory data with provenance, as Spark jobs."""
