"""Training-data operators: thirteen Spark jobs over documents, pages, conversations and embeddings.

Nothing else in the package imports this subpackage.
"""
