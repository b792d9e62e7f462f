"""Host telemetry analytics on Spark: operators over fleet-wide tables and streams."""

__version__ = "0.1.0"
