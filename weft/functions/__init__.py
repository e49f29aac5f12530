"""Part of the weft library."""
