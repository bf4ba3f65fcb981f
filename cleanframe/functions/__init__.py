"""Column expressions: parsing, rendering and canonical forms of single values."""
