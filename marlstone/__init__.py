"""A reporting-metrics engine built on Spark DataFrames."""
