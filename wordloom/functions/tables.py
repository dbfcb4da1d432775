"""Table functions for SQL: ``FROM templates t, LATERAL slot_parts(t.structure)``."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.templates import SLOT


@udtf(returnType="slot_no int, category string, count int, separator string, slot string")
class SlotParts:
    """A row for each slot of a template's text, in order; null gives none."""

    def eval(self, structure: str):
        for n, m in enumerate(re.finditer(SLOT, structure or "", re.ASCII)):
            yield n, m[1], int(m[2] or 1), " " if m[3] is None else m[3], m[0]


@udtf(returnType="place int, size bigint, digit bigint")
class Unrank:
    """The mixed-radix digits of a number, least place first: which word of each category a draw takes.

    An empty category (size 0 or null) has a null digit and takes up no room; a null number or list gives no rows.
    """

    def eval(self, number: int, sizes: list):
        if number is None:
            return
        for place, size in enumerate(sizes or []):
            if not size:
                yield place, size, None
                continue
            number, digit = divmod(number, size)
            yield place, size, digit


def register(spark: SparkSession) -> None:
    spark.udtf.register("slot_parts", SlotParts)
    spark.udtf.register("unrank", Unrank)
