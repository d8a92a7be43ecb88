"""brindle: source-code analytics as DataFrame plans."""

__version__ = "0.1.0"
