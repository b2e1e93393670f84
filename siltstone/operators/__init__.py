"""DataFrame transformations: joins, folds, windows and set operations."""
