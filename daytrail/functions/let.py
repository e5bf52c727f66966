"""Local values in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once.

    Spark evaluates a lambda outside of generated code. That also suits a long expression few
    rows need: in generated code it can make the method too long for the JVM to compile, which
    slows down every row.
    """
    return F.transform(F.array(value), body)[0]
