"""A small relational analytics engine on PySpark."""

from .session import Engine

__all__ = ["Engine"]
