"""Corpus operators: filtering, scoring, deduplication, mixing and encoding of documents at scale."""
