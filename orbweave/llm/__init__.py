"""Training-data operators: ten Spark jobs over the tables documents, pages, embeddings, labels and conversations."""
