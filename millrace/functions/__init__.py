"""Column expression builders; everything here stays inside the JVM."""
