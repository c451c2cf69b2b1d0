"""Spark-native analytics for cohorts of repeated, array-valued measurements of paired sites."""
