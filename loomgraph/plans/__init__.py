"""Queries by name."""

from . import catalogue, evaluation, intake, objects, structure  # noqa: F401  (all register their queries in the catalogue)
