"""File formats as Spark data sources."""
