"""Schema differences, table validation, alterations and migrations."""
