"""Retrieval analytics over legal and policy text, as DataFrame plans."""
