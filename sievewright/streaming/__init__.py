"""Mutations of streams."""
