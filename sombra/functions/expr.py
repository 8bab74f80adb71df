"""Expression helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (which may use it many
    times).  Catalyst would otherwise copy the expression into every use."""
    return F.element_at(F.transform(F.array(value), fn), 1)
