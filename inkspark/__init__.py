"""Marking-interpretation analytics and corpus preparation on PySpark."""
