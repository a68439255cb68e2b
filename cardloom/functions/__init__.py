"""Column functions: text, policy, scoring. All are built-in Spark expressions."""
