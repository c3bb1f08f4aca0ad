"""Query intents: catalog, normal form, checks, text output."""
