"""Column-level helpers: all JVM-side expressions (no Python per row)."""
