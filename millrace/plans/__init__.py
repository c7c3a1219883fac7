"""End-to-end jobs composed of the operators. Frame functions are lazy; ``*_job`` functions write."""
