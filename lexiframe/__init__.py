"""lexiframe: sequence, timeline, text and signal analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
