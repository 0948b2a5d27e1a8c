"""roadspark: street networks, travel demand and reallocation as PySpark plans."""
