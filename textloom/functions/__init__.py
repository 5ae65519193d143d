"""Column functions, SQL functions and table functions over text."""

from .sql import register
from .text import code_points, has_border, overlap_count, positions, quoted

__all__ = ["code_points", "has_border", "overlap_count", "positions", "quoted", "register"]
