"""Subpackage of wayfold."""
