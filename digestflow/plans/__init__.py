"""digestflow.plans."""
