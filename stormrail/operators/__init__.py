"""stormrail.operators."""
