"""Indexing plans: documents, child resources, normalised copies and full rebuilds."""
