"""digestflow: document-feed ingestion, deduplication, screening and digests on Spark."""
