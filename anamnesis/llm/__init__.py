"""Operators over the texts and vectors of a training corpus. Nothing outside this package imports it."""
