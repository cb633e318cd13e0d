"""Column-expression building blocks (JVM-side, no Python UDFs)."""
