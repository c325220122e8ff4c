"""Writers for tables and triples."""
