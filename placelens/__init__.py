"""Review analytics and place recommendation as PySpark DataFrame jobs."""
