"""Readers and writers of all formats."""

from . import readers, writers

__all__ = ["readers", "writers"]
