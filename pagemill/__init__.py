"""pagemill: catalog, geometry and raster analytics for scanned pages on Spark."""
