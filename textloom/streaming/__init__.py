"""Searches on streams of documents."""

from .matches import counts_by_window, matches

__all__ = ["counts_by_window", "matches"]
