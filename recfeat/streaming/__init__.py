"""The profile kept up to date by Structured Streaming."""
