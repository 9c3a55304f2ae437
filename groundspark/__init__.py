"""groundspark: grounded-evidence corpora on PySpark."""

__version__ = "0.1.0"
