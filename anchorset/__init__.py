"""Index-event cohort analytics on Spark."""
