"""Panel early-warning analytics as lazy Spark DataFrame transforms."""
