"""stormrail.plans."""
