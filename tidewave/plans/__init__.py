"""Queries over the tables; importing the package registers them all."""

from tidewave.plans import queries, analysis  # noqa: F401, I001
