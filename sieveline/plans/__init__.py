"""Queries over the standard tables: each applies operators of the library to whole tables."""
