"""Subpackage of loomstone."""
