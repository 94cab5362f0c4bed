"""Column functions; every one stays on the JVM."""
