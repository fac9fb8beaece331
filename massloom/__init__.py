"""massloom: mass-spectrometry and annotation analytics as lazy Spark plans."""

__version__ = "0.1.0"
