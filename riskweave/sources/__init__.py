"""Readers: files, topics, databases, table probes."""
