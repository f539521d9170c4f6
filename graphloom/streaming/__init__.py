"""Structured Streaming extensions: graph statistics kept up over a stream of events."""
