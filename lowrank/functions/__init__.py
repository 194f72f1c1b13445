"""Column expressions used by the operators (JVM-side, no Python UDFs)."""
