"""Text vectorization and classification benchmarks, written as Spark jobs."""
