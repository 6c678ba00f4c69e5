"""Operators for building text and record collections for training."""
