"""Readers and settings."""
