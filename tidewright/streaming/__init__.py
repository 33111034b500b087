"""Structured Streaming forms of bars, news, carried decisions and position books."""
