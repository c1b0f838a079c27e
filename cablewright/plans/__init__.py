"""Registered queries and their SQL; the catalogue loads its parts in their order."""

from . import catalogue  # noqa: F401
