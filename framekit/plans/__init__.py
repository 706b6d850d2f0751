"""Plans made of the operators: the query catalogue."""
