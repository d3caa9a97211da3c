"""Structured Streaming jobs of the mail model."""
