"""Pipelines of verbs and their rewriting."""
