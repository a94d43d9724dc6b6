"""Analytics over correspondence and documents as PySpark jobs."""
