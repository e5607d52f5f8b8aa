"""Operators that prepare text, conversations and measures for training data."""
