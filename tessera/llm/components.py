"""Connected components, as the library has them."""

from tessera.operators.components import connected_components

__all__ = ["connected_components"]
