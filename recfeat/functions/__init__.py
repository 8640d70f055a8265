"""Column functions on texts, vectors and pixels."""
