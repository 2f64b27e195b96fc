"""Streaming operators; each has a batch twin that its query is compared with."""
