"""quire: document conversion and corpus analytics as Spark jobs."""
