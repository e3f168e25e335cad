"""Operators of a training-data pipeline (documents, pages, embeddings). Nothing else in the library imports it."""
