"""Connected components of an edge table: those of the library, under the corpus operators' name."""

from taleloom.operators.components import connected_components

__all__ = ["connected_components"]
