"""cardloom: a PySpark engine for memory cards, change feeds and document corpora."""

__version__ = "0.1.0"
