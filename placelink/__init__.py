"""placelink: place-name databases and text linking as Spark DataFrame plans."""

__version__ = "0.1.0"
