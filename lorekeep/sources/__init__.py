"""Readers of raw logs and native transcripts."""
