"""Operators for preparing large training corpora and for mergeable summaries."""
