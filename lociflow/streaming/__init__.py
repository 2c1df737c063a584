"""Streaming forms of the operators that need no order between reads."""
