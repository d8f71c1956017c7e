"""Column functions: bits and semirings."""
