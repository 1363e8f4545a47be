"""Audit of how filters interact: what each removes, alone and in every order, from joint failures.

For each part of the table (a language) the rows that fail all filters of a set are counted, for each of the 2**n sets, as
sums of products of the filters' flags. These joint failures J(R) hold all there is to know:

    rows that no filter of T rejects      the sum over R within T of (-1)**|R| J(R)
    rows that fail f alone                the sum over R with f of (-1)**(|R| - 1) J(R)
    Harsanyi dividend of R                (-1)**(|R| + 1) J(R), for the game "rows that T removes"
    Shapley value of f                    the sum over R with f of dividend / |R|

so every order of the filters follows from one pass over the rows, and the orders (n! of them) meet a table of one row a
part only. Texts are read once, into a narrow table of flags and a digest; copies are found by the smallest id of a digest.

A null text counts as empty, a null part as the empty string. "Identical to any smaller id's text" never holds for a null
id, nor between rows of one id. Repeated rows count each. A row is good (toxic) if any label row of its id says so; labels
without an id count for nothing. Texts of any length are read whole. Other columns, of whatever name, are left out. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locspark.llm import common

#: Stands for the rule "identical to the text of a smaller id", which no expression over one row can tell.
COPY = "copy"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def default_filters() -> dict[str, Column | str]:
    """What fails each filter, by its letter, as an expression over the columns text and words."""
    n, capitals = F.size("words"), F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200, "B": 100 * F.size(F.array_distinct("words")) < 50 * n, "C": 100 * capitals.cast("long") > 3 * F.length("text").cast("long"),
        "D": F.col("text").rlike(r"[#$%&*|]"), "E": COPY,
    }


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, one flag of 0 or 1 by the name of each filter, good, toxic) of each row of `docs`."""
    filters = filters or default_filters()
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    flags = [f.cast("int").alias(name) for name, f in filters.items() if not isinstance(f, str)]
    copies = [name for name, f in filters.items() if isinstance(f, str)]
    read = own.withColumn("words", words(F.col("text"))).select("doc_id", "part", *flags, F.unhex(F.sha2("text", 256)).alias("digest"))
    # rows without an id have no label: they go to all tasks alike
    rows = common.written(read.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096))).otherwise(F.lit(0).cast("long"))))
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("spread"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    said = said.filter("doc_id is not null and (good = 1 or toxic = 1)").groupBy("doc_id", "spread").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    out = rows.join(said, ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"])
    if copies:
        least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null").drop("n")
        copy = F.coalesce((F.col("doc_id") > F.col("least")).cast("int"), F.lit(0))
        out = out.join(least, "digest", "left").select("*", *(copy.alias(name) for name in copies))
    return out.select("doc_id", "part", *filters, "good", "toxic")


def _within(mask: int) -> list[int]:
    """The sets within a set, as bits."""
    return [r for r in range(mask + 1) if r & mask == r]


def joint_failures(flagged: DataFrame, filters: list[str]) -> DataFrame:
    """(part, joint, joint_good, joint_toxic): arrays of how many rows fail all filters of each set; bit i of the index is filter i."""

    def sums(weight: str) -> Column:
        products = [" * ".join([f"cast({weight} as bigint)", *(f"`{name}`" for i, name in enumerate(filters) if mask >> i & 1)]) for mask in range(1 << len(filters))]
        return F.expr(f"array({', '.join(f'sum({p})' for p in products)})")

    return flagged.withColumn("one", F.lit(1)).groupBy("part").agg(sums("one").alias("joint"), sums("good").alias("joint_good"), sums("toxic").alias("joint_toxic"))


def _signed(joint: str, sets: Iterable[int], sign: Callable[[int], int]) -> str:
    """The joint failures of some sets, each times a number that its size gives, added up."""
    return " + ".join(f"{sign(r.bit_count())} * {joint}[{r}]" for r in sets)


def _survivors(joint: str, n: int) -> Column:
    """Of each set of filters the rows that none of them rejects."""
    return F.expr(f"array({', '.join(_signed(joint, _within(t), lambda k: (-1) ** k) for t in range(1 << n))})")


def interactions(joint: DataFrame, filters: list[str]) -> DataFrame:
    """(part, filters, n_joint, dividend) of each set of filters that isn't empty: rows that fail them all, and its Harsanyi dividend."""
    sets = F.array(*(F.struct(F.lit("".join(f for i, f in enumerate(filters) if m >> i & 1)).alias("filters"), F.col("joint")[m].alias("n_joint"), (F.col("joint")[m] * (-1) ** (m.bit_count() + 1)).alias("dividend")) for m in range(1, 1 << len(filters))))
    return joint.select("part", F.explode(sets).alias("s")).select("part", "s.*")


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each part, order of the filters and step.

    filters: by a letter each, what fails it, over the columns text and words, or `COPY`. shapley: in units of 1 / n!, so
    that it is the sum over all orders.
    """
    filters = filters or default_filters()
    names, n = list(filters), len(filters)
    joint = joint_failures(failures(docs, labels, filters, key, text, part), names)
    having = [[m for m in range(1, 1 << n) if m >> i & 1] for i in range(n)]
    orders = factorial(n)  # a multiple of every |R|
    alone = F.expr(f"array({', '.join(_signed('joint', own, lambda k: (-1) ** (k - 1)) for own in having)})")
    value = F.expr(f"array({', '.join(_signed('joint', own, lambda k: (-1) ** (k + 1) * (orders // k)) for own in having)})")
    figures = joint.select("part", "joint", _survivors("joint", n).alias("left"), _survivors("joint_good", n).alias("left_good"), _survivors("joint_toxic", n).alias("left_toxic"), alone.alias("alone"), value.alias("value"))
    steps = F.expr("array(" + ", ".join(f"array({', '.join(map(str, p))})" for p in permutations(range(n))) + ")")
    letters = F.expr(f"array({', '.join(repr(x) for x in names)})")
    at = figures.withColumn("order", F.explode(steps)).withColumn("filter_order", F.concat_ws("", F.transform("order", lambda i: F.get(letters, i)))).select("*", F.posexplode("order").alias("pos", "f"))
    bit = F.expr("shiftleft(1, f)")
    before = F.expr("aggregate(slice(order, 1, pos), 0, (a, i) -> a | shiftleft(1, i))")
    at = at.withColumn("bit", bit).withColumn("before", before).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    lost = lambda c: F.expr(f"{c}[before] - {c}[after]")
    return at.select(
        "part", "filter_order", (F.col("pos") + 1).cast("int").alias("step"), F.expr("left[after]").alias("kept"), lost("`left`").alias("removed"), (F.expr("joint[bit]") - lost("`left`")).alias("redundant"),
        F.expr("alone[f]").alias("unique_fails"), lost("left_good").alias("good_lost"), lost("left_toxic").alias("toxic_lost"), F.expr("value[f]").alias("shapley"),
    )
