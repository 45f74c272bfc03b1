"""Exact semantic similarity search over content-addressed file trees, on Spark."""

from __future__ import annotations

__version__ = "0.1.0"
