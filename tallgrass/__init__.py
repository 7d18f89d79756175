"""Tallgrass: media-catalog analytics and corpus preparation as Spark jobs."""
