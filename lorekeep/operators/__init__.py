"""Operators over the event model."""
