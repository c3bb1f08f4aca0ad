"""Reading and writing intents."""
