"""A Spark-native refinery for web pages, documents and crawl events."""
