from tideline.functions.vectors import (
    dot,
    format_center,
    hash_unit,
    nearest_center,
    squared_distance,
)

__all__ = ["dot", "format_center", "hash_unit", "nearest_center", "squared_distance"]
