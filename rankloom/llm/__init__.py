"""Training-data operators: ten operators over documents, pages and vectors, and their queries."""
