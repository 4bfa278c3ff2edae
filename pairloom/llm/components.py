"""Connected components of linked documents; see ``pairloom.operators.components``."""

from pairloom.operators.components import connected_components

__all__ = ["connected_components"]
