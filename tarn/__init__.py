"""Raster, terrain and corpus analytics on PySpark."""
