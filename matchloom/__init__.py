"""PySpark analytics over match and participation telemetry."""
