"""textlake: analytics over large collections of text files, on PySpark."""

__version__ = "0.1.0"
