"""Study-material and learning analytics as composable Spark DataFrame transforms."""
