"""Spark-native analytics for scraped menu corpora and other messy text."""
