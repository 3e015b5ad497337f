"""Datasets and their operators."""
