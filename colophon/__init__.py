"""Spark jobs that turn long documents into catalogue metadata."""
