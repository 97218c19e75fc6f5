"""Structured Streaming form of the strike roll-up (STR1)."""
