"""Readers, topic folders and the synthetic event generator."""
