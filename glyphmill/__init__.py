"""Text-forensics analytics on Spark: corpora, language models, scorers, phrase tables and evaluation as DataFrame plans."""

__version__ = "0.1.0"
