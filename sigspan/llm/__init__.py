"""Training-data operators on documents, pages and embeddings. Nothing outside imports this."""
