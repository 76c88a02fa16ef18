"""Shape similarity of 3-D point clouds on Spark."""

__version__ = "0.1.0"
