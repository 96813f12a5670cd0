"""Compositions of operators: the batch run, and the query catalogue over the test tables."""
