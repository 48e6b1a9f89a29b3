"""relgen: relational schemas as data, on PySpark."""

__version__ = "1.0.0"
