"""Readers and writers: timed text, segment documents, logs, media listings, rule and truth files."""
