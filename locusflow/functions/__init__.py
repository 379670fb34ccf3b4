"""Subpackage of locusflow."""
