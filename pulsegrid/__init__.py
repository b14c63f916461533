"""Device telemetry on Spark: ingest, per-user rule alerts and operational analytics."""
