"""Telemetry tables bound to the benchmark tables, and the registered queries."""
