"""Schema intelligence and graph mapping on Spark."""
