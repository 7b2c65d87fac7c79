"""Operators for training data at corpus scale.  Nothing outside this package imports it."""
