"""Code, array and text expressions."""
