"""The event checks on arriving files, with Structured Streaming."""
