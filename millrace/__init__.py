"""millrace: matching analytics and text-data processing on PySpark."""

__version__ = "0.1.0"
