"""Structured Streaming forms of currency, rates, sessions and daily caps (an extension)."""
