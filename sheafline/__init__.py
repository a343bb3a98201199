"""Document extraction, reconciliation and corpus preparation on Spark."""
