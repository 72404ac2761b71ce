"""Stateful operators over streams, with batch forms where they help."""
