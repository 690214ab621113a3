"""The operators in micro-batches."""
