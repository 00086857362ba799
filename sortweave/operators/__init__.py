"""DataFrame operators: sort, argsort, runs, splitters, merge and verification."""
