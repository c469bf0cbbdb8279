"""Column -> Column building blocks that stay inside the JVM."""
