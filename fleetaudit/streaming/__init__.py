"""Structured Streaming jobs over audit events, deliveries and activity."""
