"""Structured Streaming operators; each gives the rows its batch counterpart gives."""
