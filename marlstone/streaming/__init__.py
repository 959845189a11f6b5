"""Streams: the queue of reviews to index, usage, limits kept as state, and polling with a cursor."""
