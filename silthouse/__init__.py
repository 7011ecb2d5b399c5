"""silthouse: dataset versioning, query and analytics operators written for PySpark."""

__version__ = "0.1.0"
