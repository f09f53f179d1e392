"""Spark jobs over assistant session logs and the article library built from them."""

__version__ = "0.1.0"
