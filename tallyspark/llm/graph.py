"""Connected components of links between documents."""

from ..operators.graph import components

__all__ = ["components"]
