"""Document analytics on Spark: page-description files as relations, and relational operators over them."""

__version__ = "0.1.0"
