"""digestflow.sources."""
