"""Connected components, as the engine has them."""

from millrace.operators.components import connected_components

__all__ = ["connected_components"]
