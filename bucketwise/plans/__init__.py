"""Query descriptions and planning that needs no Spark."""
