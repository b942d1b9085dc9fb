"""Column functions: no I/O, no state, null rules stated where they matter."""
