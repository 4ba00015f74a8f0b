"""Functions that SQL alone does not express."""
