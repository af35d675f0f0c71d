"""Relational operators over documents, tokens, tags and vectors."""
