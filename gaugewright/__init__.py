"""Evaluation of language-model and retrieval applications, and corpus preparation, as Spark jobs."""
