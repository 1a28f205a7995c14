"""Live operation with Structured Streaming: state per clip, constant in the clip's length."""
