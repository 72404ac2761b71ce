"""Readers of catalogs and protocol payloads."""
