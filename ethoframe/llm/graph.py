"""Connected components, as the training-data operators use them."""

from ethoframe.graph import components

__all__ = ["components"]
