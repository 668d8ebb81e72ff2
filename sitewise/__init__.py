"""Cohorts, hourly series, window features and site-transfer evaluation on Spark."""
