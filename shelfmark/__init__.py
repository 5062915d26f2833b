"""A Spark-first engine for a media library's catalogue, search and quality queries."""
