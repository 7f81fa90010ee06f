"""Spark jobs that turn crawled pages, reports, documents and logs into traceable information."""
