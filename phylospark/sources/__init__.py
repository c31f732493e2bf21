"""Trees, tables and result directories."""
