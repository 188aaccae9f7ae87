"""Operators of this family; see the README."""
