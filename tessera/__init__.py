"""Tessera: document analytics, retrieval and conversation analytics as Spark jobs."""
