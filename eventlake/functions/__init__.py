"""Column functions: every one builds a JVM-side expression, none is a Python UDF."""
