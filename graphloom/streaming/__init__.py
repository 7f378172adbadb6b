"""Streaming ingestion and stateful operators."""
