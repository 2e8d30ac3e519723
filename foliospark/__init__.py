"""foliospark: document assembly and text processing for scanned and born-digital books on Spark DataFrames."""

__version__ = "0.1.0"
