"""digestflow.operators."""
