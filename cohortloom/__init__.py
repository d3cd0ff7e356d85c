"""Patient-cohort analytics as PySpark DataFrame jobs."""
