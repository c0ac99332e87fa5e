"""Connected components, from the library."""

from ..operators.graph import connected_components

__all__ = ["connected_components"]
