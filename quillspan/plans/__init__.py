"""Document-level jobs composed of operators."""
