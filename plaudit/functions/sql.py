"""Expressions written as SQL text: one parse instead of a call per node."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def quoted(value: str) -> str:
    """String literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted_list(values: Iterable[str]) -> str:
    return ", ".join(quoted(value) for value in values)


def filled(template: str, **constants: object) -> Column:
    """The template with each ``{name}`` replaced by a constant or else by the column of that name.

    Null when one of the columns is null.
    """
    parts = []
    for at, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if at % 2 == 0:
            parts.append(quoted(part))
        elif part in constants:
            parts.append(quoted(str(constants[part])))
        else:
            parts.append(f"string(`{part}`)")
    return F.expr(f"concat({', '.join(parts)})")
