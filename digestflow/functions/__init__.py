"""digestflow.functions."""
