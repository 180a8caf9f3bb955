"""Part of the reporting-metrics engine."""
