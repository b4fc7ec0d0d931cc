"""Document-corpus analytics as Spark jobs over tables of documents, pages, lines, words and findings."""

__version__ = "0.1.0"
