"""tiltlab: signal evaluation and portfolio construction as Spark jobs."""
