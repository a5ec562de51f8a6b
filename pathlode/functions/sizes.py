"""Sizes: argument texts, size columns, and sizes for people."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size names are points, units are decimal.
SIZE_NAMES = {
    "empty": 0,
    "tiny": 10 * 1024,
    "small": 100 * 1024,
    "medium": 1024 * 1024,
    "large": 16 * 1024 * 1024,
    "huge": 128 * 1024 * 1024,
    "gigantic": 128 * 1024 * 1024 + 1,
}
SIZE_UNITS = {"kb": 1_000, "mb": 1_000_000, "gb": 1_000_000_000}
DISPLAY_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]

Bounds = tuple[int | None, int | None]


def parse_size(text: str) -> int:
    """``10``, ``5kb``, ``2 mb``, ``huge`` in bytes."""
    value = text.strip().lower()
    if value in SIZE_NAMES:
        return SIZE_NAMES[value]
    number = re.fullmatch(r"\+?([0-9]+)(?:\s*(kb|mb|gb))?", value)
    if not number:
        raise ValueError(f"invalid size: {value}")
    size = int(number[1]) * SIZE_UNITS.get(number[2], 1)
    if size > 2**63 - 1:
        raise ValueError(f"invalid size: {value} is out of range")
    return size


_COMPARED = re.compile(r"(?P<sign>[<>]=?|)(?P<size>.*)", re.S)


def size_bounds(text: str) -> Bounds:
    """Closed bounds of ``a..b``, ``a-b``, ``>=a``, ``<=a``, ``>a``, ``<a`` or ``a``."""
    value = text.strip()
    separator = ".." if ".." in value else "-"
    if separator in value:
        low, _, high = value.partition(separator)
        return parse_size(low), parse_size(high)
    sign, size = _COMPARED.fullmatch(value).group("sign", "size")
    limit = parse_size(size)
    bounds = {
        "": (limit, limit),
        ">=": (limit, None),
        "<=": (None, limit),
        ">": (limit + 1, None),
        "<": (None, limit - 1),
    }[sign]
    if bounds[1] == -1:
        raise ValueError("no file is smaller than nothing")
    return bounds


def size_of_text(text: Column) -> Column:
    """Column form of :func:`parse_size`; null where the text is no size."""
    value = F.lower(F.trim(text))
    number = F.regexp_extract(value, r"^\+?([0-9]+)\s*(kb|mb|gb)?$", 1).try_cast("bigint")
    unit = F.lit(1)
    for suffix, factor in SIZE_UNITS.items():
        unit = F.when(value.endswith(suffix), factor).otherwise(unit)
    out = F.try_multiply(number, unit.cast("bigint"))
    for name, size in SIZE_NAMES.items():
        out = F.when(value == name, F.lit(size).cast("bigint")).otherwise(out)
    return out


def _one_decimal(size: Column, power: int, half_even: bool) -> Column:
    """``size / 2**power`` with one decimal, by whole-number arithmetic only."""
    unit = F.lit(1 << power)
    rest = size.bitwiseAND(F.lit((1 << power) - 1)) * 10
    tenths = F.shiftright(size, power) * 10 + F.shiftright(rest, power)
    twice_left = rest.bitwiseAND(F.lit((1 << power) - 1)) * 2
    tie_goes_up = tenths.bitwiseAND(F.lit(1)) == 1 if half_even else F.lit(True)
    goes_up = (twice_left > unit) | ((twice_left == unit) & tie_goes_up)
    digits = F.when(goes_up, tenths + 1).otherwise(tenths).cast("string")
    return F.concat(
        F.left(digits, F.length(digits) - 1), F.lit("."), F.right(digits, F.lit(1))
    )


def _display(size: Column, below: Column, half_even: bool) -> Column:
    out = below
    for step, unit in enumerate(DISPLAY_UNITS[1:], start=1):
        number = F.concat(_one_decimal(size, 10 * step, half_even), F.lit(" " + unit))
        out = F.when(size >= 1 << (10 * step), number).otherwise(out)
    return out


def format_size(size: Column) -> Column:
    """``512 B``, ``1.5 KB`` ... in steps of 1024; an exact half rounds to the even digit."""
    size = size.cast("bigint")
    return _display(size, F.concat(size.cast("string"), F.lit(" B")), half_even=True)


def format_size_ui(size: Column) -> Column:
    """The desktop variant: ``0 B``, ``512.0 B``, ``1.0 KB``; an exact half rounds up."""
    size = size.cast("bigint")
    below = F.when(size == 0, F.lit("0 B")).otherwise(
        F.concat(size.cast("string"), F.lit(".0 B"))
    )
    return _display(size, below, half_even=False)
