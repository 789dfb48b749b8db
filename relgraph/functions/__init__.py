"""Column functions: all of them run inside the JVM."""
