"""Intermediate tables of the corpus operators."""

from wayfold.store import shared_folder, table

__all__ = ["shared_folder", "table"]
