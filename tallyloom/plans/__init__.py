"""Registered queries. The catalog comes first, as the other modules register theirs with it."""

from tallyloom.plans import catalog  # noqa: F401
