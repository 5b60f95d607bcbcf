"""quillforge: a PySpark-native engine for reward-scored text data and training corpora."""

__version__ = "0.1.0"
