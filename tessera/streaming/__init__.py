"""Copies that follow a growing source."""

from .follow import follow

__all__ = ["follow"]
