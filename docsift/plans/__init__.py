"""Whole jobs: indexing files into documents, and searching documents."""
