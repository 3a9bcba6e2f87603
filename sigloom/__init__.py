"""Security-event detection and corpus jobs expressed as Spark DataFrame programs."""
