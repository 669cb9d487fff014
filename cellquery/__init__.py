"""Question and answer sets over tables, built and scored as Spark jobs."""

__version__ = "0.1.0"
