"""Settings and bounds, on the driver."""

from __future__ import annotations

import re

_UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def parse_size(text: str) -> int | None:
    """Bytes of a size such as 1GB, 10 kb or 1.5M; None if it is none."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGT]?)I?B?\s*", text.upper())
    return int(float(m[1]) * _UNITS[m[2]]) if m else None


def parse_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parse_count(text: str) -> int | None:
    """A count of 0 or more, where all means 0 (no limit); None if it is none."""
    low = text.strip().lower()
    return 0 if low == "all" else int(low) if low.isascii() and low.isdigit() else None


def keyword_range(total: int, offset: int, n: int) -> tuple[int, int]:
    """The bounds of a window of keywords inside total; no n means to the end."""
    start = min(max(0, offset), total)
    return start, total if n <= 0 else min(total, start + n)
