"""Operators over catalog and protocol tables."""
