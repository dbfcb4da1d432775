"""Templates: slot parsing, needs, combination counts, usage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: slot syntax {category}, {category:count}, {category:count:separator}.
SLOT = r"\{(\w+)(?::(\d+))?(?::([^}]*))?\}"
BIG = "decimal(38,0)"


def _slot_array() -> Column:
    """Slots of ``structure`` in order.

    A missing separator is a blank, an empty one stays empty; the regex gives '' for both, so the length
    of the whole match tells them apart.
    """
    groups = [F.regexp_extract_all("structure", F.lit(SLOT), F.lit(i)) for i in range(4)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("slot", "category", "digits", "sep"))])

    def named(m: Column) -> Column:
        used = F.length(m["category"]) + 2 + F.when(m["digits"] != "", F.length(m["digits"]) + 1).otherwise(0)
        return F.struct(
            m["category"].alias("category"),
            F.when(m["digits"] != "", m["digits"].cast("int")).otherwise(1).alias("count"),
            F.when(F.length(m["slot"]) > used, m["sep"]).otherwise(" ").alias("separator"),
            m["slot"].alias("slot"),
        )

    return F.transform(zipped, named)


def parse_slots(templates: DataFrame) -> DataFrame:
    """One row per slot: (template_id, slot_no, category, count, separator, slot)."""
    s = templates.select(F.col("id").alias("template_id"), F.posexplode(_slot_array()).alias("slot_no", "s"))
    return s.select("template_id", "slot_no", "s.*")


def literals(templates: DataFrame) -> DataFrame:
    """The text around the slots: one more piece than slots."""
    return templates.select(F.col("id").alias("template_id"), F.split("structure", SLOT, -1).alias("pieces"))


def template_parts(templates: DataFrame) -> DataFrame:
    """One row per template: its slots and the text around them."""
    return templates.select(
        F.col("id").alias("template_id"), F.split("structure", SLOT, -1).alias("pieces"), _slot_array().alias("slots")
    )


def template_needs(slots: DataFrame) -> DataFrame:
    return slots.groupBy("template_id", "category").agg(F.sum("count").alias("need"))


def falling(n: Column, k: Column) -> Column:
    """n (n-1) ... (n-k+1), each factor at least 1, as an exact big integer."""
    factor = lambda i: F.greatest(n - i, F.lit(1)).cast("decimal(20,0)")
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.lit(1).cast(BIG), lambda p, i: (p * factor(i)).cast(BIG))


def factorial(k: Column) -> Column:
    return falling(k, k)


def _product(c: str) -> Column:
    # one entry per category of a template
    return F.aggregate(F.collect_list(c), F.lit(1).cast(BIG), lambda p, x: (p * x).cast(BIG))


def combinations(slots: DataFrame, components: DataFrame) -> DataFrame:
    """Per template the ordered draws (``permutations``) and the distinct hashes (``hash_distinct``).

    The hash sorts the words of a category, so swapping two words of a double slot is the same prompt.
    """
    sizes = components.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    k = F.col("need").cast("bigint")
    drawn = F.least(k, n)
    terms = template_needs(slots).join(sizes, "category", "left").select(
        "template_id", falling(n, k).alias("perm"),
        (falling(n, drawn) / factorial(drawn)).cast(BIG).alias("comb"),
    )
    return terms.groupBy("template_id").agg(_product("perm").alias("permutations"), _product("comb").alias("hash_distinct"))


def total_combinations(slots: DataFrame, components: DataFrame) -> DataFrame:
    c = combinations(slots, components)
    return c.agg(F.sum("permutations").cast(BIG).alias("permutations"), F.sum("hash_distinct").cast(BIG).alias("hash_distinct"))


def structure_features(slots: DataFrame) -> DataFrame:
    """Slots, categories in slot order, and categories needed more than once."""
    multi = template_needs(slots).groupBy("template_id").agg(F.count_if(F.col("need") > 1).alias("multi_slots"))
    shape = slots.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("n_slots"),
        F.transform(F.array_sort(F.collect_list(F.struct("slot_no", "category"))), lambda s: s["category"]).alias("slot_categories"),
    )
    return shape.join(multi, "template_id")


def category_usage(slots: DataFrame, categories: list[str]) -> DataFrame:
    """Template by category table of slot occurrences, with the total over the listed categories."""
    wide = slots.groupBy("template_id").pivot("category", categories).count()
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in categories]
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in categories), F.lit(0))
    return wide.select("template_id", *filled, total.cast("bigint").alias("total"))
