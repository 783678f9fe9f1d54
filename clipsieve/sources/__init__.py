"""Readers: media listings, logs, transcripts and JSON documents as tables."""
