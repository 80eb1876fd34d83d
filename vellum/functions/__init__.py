"""Column-level scalar functions (JVM-side built-ins only)."""
