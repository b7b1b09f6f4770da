"""folio: Spark jobs for page-translation data (catalogue, reply parsing, layout checks, job telemetry)."""
