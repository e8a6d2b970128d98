"""Crawl analytics and corpus preparation on Spark."""
