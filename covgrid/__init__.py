"""covgrid: mobile-coverage and railway analytics as Spark DataFrame jobs."""
