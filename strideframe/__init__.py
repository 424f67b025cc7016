"""Motion metrics over pose, detection and annotation tables, as Spark DataFrame jobs."""
