"""Structured Streaming: documents that arrive as files give the same tables as one batch run."""
