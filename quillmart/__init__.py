"""Quillmart: Spark jobs for product catalogs, their search, curation and query logs."""
