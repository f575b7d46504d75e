"""Operators that prepare a pool of texts for training language models."""
