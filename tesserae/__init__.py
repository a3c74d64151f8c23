"""Raster catalogue, raster analytics and training-data operators as PySpark DataFrame programs."""
