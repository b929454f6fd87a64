"""Operators for preparing training data from sequences and text."""
