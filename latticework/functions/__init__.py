"""Column expressions: strings, numbers, reduced-precision floats, shapes, checksums."""
