"""Hammerfield: listing-data analytics as PySpark DataFrame programs."""
