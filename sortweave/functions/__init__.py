"""Column expressions: byte order, key orders, record codec, sizes and metrics."""
