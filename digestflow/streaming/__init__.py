"""digestflow.streaming."""
