"""Registered queries of the archive: importing this package fills the registry."""

from . import catalogue, contents, streaming, taxonomy
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "contents", "streaming", "taxonomy"]
