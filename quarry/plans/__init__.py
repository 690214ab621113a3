"""Query states and their compilation to Columns."""
