"""Rule-driven spatial data quality and text-corpus operators as lazy Spark plans."""
