"""Training-data operators: the ten large-corpus operators and their queries."""
