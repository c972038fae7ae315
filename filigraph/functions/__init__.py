"""Subpackage of filigraph."""
