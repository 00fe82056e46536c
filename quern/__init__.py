"""quern: a PySpark-native engine that mills conversational records into fine-tuning data."""

__version__ = "0.1.0"
