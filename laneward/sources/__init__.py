"""Readers and writers: request, payload, page and state tables."""
