"""Single-pass edge streams over Structured Streaming."""
