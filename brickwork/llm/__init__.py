"""Training-data operators: thirteen corpus-scale steps, their queries and SQL."""
