"""Time-lapse raster, region-graph and root-forest analytics as Spark jobs."""
