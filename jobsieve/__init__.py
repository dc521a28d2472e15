"""jobsieve: a PySpark-native engine for job postings, documents and the activity around them."""

__version__ = "0.1.0"
