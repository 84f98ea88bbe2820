"""Barloom: daily-panel analytics and corpus preparation as PySpark DataFrame jobs."""
