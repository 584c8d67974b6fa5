"""Corpus operators for training data. Nothing else in wayfold imports this subpackage."""
