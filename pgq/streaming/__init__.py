"""Intents as a stream."""
