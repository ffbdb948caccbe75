"""Column expressions: lexicons, text scoring, vectors and test statistics."""
