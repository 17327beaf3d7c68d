"""Statute corpus, vector search and prompt answering as Spark jobs."""
