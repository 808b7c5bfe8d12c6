"""Polar terrain grids from depth-camera point clouds, as Spark DataFrame operations."""
