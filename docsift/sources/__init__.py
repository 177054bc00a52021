"""Reading files and tables into documents, and writing document tables."""
