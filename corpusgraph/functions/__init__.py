"""Column functions; all run inside the JVM unless their module says otherwise."""
