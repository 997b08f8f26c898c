"""Intermediate tables in the shared folder that the session names."""

from leafgraph.sources.scratch import fresh_path, remove, scratch
from leafgraph.sources.scratch import kept as stored

__all__ = ["fresh_path", "remove", "scratch", "stored"]
