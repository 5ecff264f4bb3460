"""Column functions. Built from Spark expressions only, so they stay in the JVM."""
