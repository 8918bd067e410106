"""crawlframe: crawl-data jobs written as Spark DataFrame and Structured Streaming code."""
