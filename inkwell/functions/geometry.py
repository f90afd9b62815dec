"""Box arithmetic as native columns; boxes are half-open pixel rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, int) else low, F.least(c, high))


def expand(x1: Column, y1: Column, x2: Column, y2: Column, pad_x: int, pad_y: int, width: Column, height: Column) -> dict[str, Column]:
    """The box padded and clamped to the last pixel."""
    return {
        "x1": F.greatest(F.lit(0), x1 - pad_x), "y1": F.greatest(F.lit(0), y1 - pad_y),
        "x2": F.least(width - 1, x2 + pad_x), "y2": F.least(height - 1, y2 + pad_y),
    }


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel box of a normalised centre box, truncated and clamped to the last pixel."""
    cut = lambda c, most: clamp(c.cast("int"), 0, most - 1)
    return {
        "x1": cut((cx - w / 2) * width, width), "y1": cut((cy - h / 2) * height, height),
        "x2": cut((cx + w / 2) * width, width), "y2": cut((cy + h / 2) * height, height),
    }


def from_centre_padded(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column, pad: int = 8) -> dict[str, Column]:
    """As the label cropper reads them: padded, starts to the last pixel, ends to the full size."""
    box = {
        "x1": ((cx - w / 2) * width).cast("int") - pad, "y1": ((cy - h / 2) * height).cast("int") - pad,
        "x2": ((cx + w / 2) * width).cast("int") + pad, "y2": ((cy + h / 2) * height).cast("int") + pad,
    }
    return {
        "x1": clamp(box["x1"], 0, width - 1), "y1": clamp(box["y1"], 0, height - 1),
        "x2": clamp(box["x2"], 1, width), "y2": clamp(box["y2"], 1, height),
    }


def to_centre(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """Normalised centre form."""
    return {"cx": (x1 + x2) / 2.0 / width, "cy": (y1 + y2) / 2.0 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height}


def valid(x1: Column, y1: Column, x2: Column, y2: Column, min_width: int = 1, min_height: int = 1) -> Column:
    return (x2 - x1 >= min_width) & (y2 - y1 >= min_height)
