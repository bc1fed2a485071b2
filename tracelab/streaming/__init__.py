"""Streams: keyed state that outlives a restart."""
