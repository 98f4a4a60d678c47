"""DataFrame operators: matching, catalog, descriptives, models, draws, embeddings, validation."""
