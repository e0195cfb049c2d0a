"""Detection rules as data."""
