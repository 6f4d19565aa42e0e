"""Documents mixed to target weights by pivotal rounding.

Every document of a source is to be copied equally often on average, which is seldom a whole
number.  The fractions are made whole in duels: two documents pass words between them until one
has no fraction left, in one direction or the other by chance, with odds that leave
each document's mean as it was.  The words of the source stay the same in every duel, so only its last
document misses the target, by less than its size.

Duels are held in groups of bounded size, all at once, each leaving one document with a fraction.
Those meet in groups again, and so on: a tree whose depth is the logarithm of the source's
documents.  One group of whole documents waits for the last level, so that what is left there is
settled among many and ends in a short one.  Chance is a hash of the documents, so a rerun
gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import ceil_div, join_by_key, let, numbered

#: documents of a group of duels, on average
GROUP = 256
WORD = r"[^\x20\x09-\x0D]+"
#: rows that one step of repeating makes of a row
BLOCK = 4096

_ITEM = "struct<falling:long,tie:long,id:{id},text_hash:long,n:long,copies:long,mass:double>"


def _chance(seed: int, *columns: Column) -> Column:
    """Even in [0, 1), from the values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _with_mass(item: Column, mass: Column) -> Column:
    return item.withField("mass", mass)


def _duel(seed: int, a: Column, b: Column) -> Column:
    """(done, rest) after `a` and `b` pass words until one of them is whole.

    `a` may be null, in the first duel, or whole already; then it is done and `b` is the rest.
    """
    size_a, size_b = -a["falling"], -b["falling"]
    up = F.least(size_a - a["mass"], b["mass"])
    down = F.least(a["mass"], size_b - b["mass"])
    rises = _chance(seed, a["tie"], b["tie"]) * (up + down) < down

    def after(m: Column) -> Column:
        """`m`: whether a rises, and the words that pass."""
        to_a = F.when(m["rises"], m["up"]).otherwise(-m["down"])
        # the one that set the limit becomes whole exactly, without rounding
        new_a = (
            F.when(m["rises"] & (m["up"] == size_a - a["mass"]), size_a.cast("double"))
            .when(~m["rises"] & (m["down"] == a["mass"]), F.lit(0.0))
            .otherwise(a["mass"] + to_a)
        )
        new_b = (
            F.when(m["rises"] & (m["up"] == b["mass"]), F.lit(0.0))
            .when(~m["rises"] & (m["down"] == size_b - b["mass"]), size_b.cast("double"))
            .otherwise(b["mass"] - to_a)
        )
        return let(
            F.struct(_with_mass(a, new_a).alias("a"), _with_mass(b, new_b).alias("b")),
            lambda p: F.when(
                _is_whole(p["b"]), F.struct(p["b"].alias("done"), p["a"].alias("rest"))
            ).otherwise(F.struct(p["a"].alias("done"), p["b"].alias("rest"))),
        )

    fought = let(
        F.struct(rises.alias("rises"), up.alias("up"), down.alias("down")), after
    )
    return F.when(
        a.isNull() | _is_whole(a), F.struct(a.alias("done"), b.alias("rest"))
    ).otherwise(fought)


def _is_whole(item: Column) -> Column:
    return (item["mass"] <= 0) | (item["mass"] >= -item["falling"])


def _settle(items: DataFrame, kind: str, seed: int) -> DataFrame:
    """(source, chunk, done, rest) of each group: its items in falling size, duel after duel."""
    begin = F.struct(
        F.lit(None).cast(kind).alias("rest"), F.array().cast(f"array<{kind}>").alias("done")
    )

    def step(state: Column, item: Column) -> Column:
        return let(
            _duel(seed, state["rest"], item),
            lambda d: F.struct(
                d["rest"].alias("rest"), F.array_append(state["done"], d["done"]).alias("done")
            ),
        )

    return (
        items.groupBy("source", "chunk")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select("source", "chunk", F.aggregate("items", begin, step).alias("s"))
        .select("source", "chunk", "s.done", "s.rest")
    )


def _targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """`sources` (staged: source, source_size, n) with target.

    Sources in order, null last, weigh `weights` in turn.  Places come from the counts
    of ranges, so no task sees all sources; what is above `most` times the size of a source goes
    to the others by weight, until none is above.
    """
    dealt = stage(
        sources.repartitionByRange(F.asc_nulls_last("source"))
        .withColumn("range", F.spark_partition_id()),
        "mix-sources-by-range",
    )
    starts, before = {}, 0
    for r in dealt.groupBy("range").count().orderBy("range").collect():
        starts[r["range"]] = before
        before += r["count"]
    total = dealt.agg(F.sum("source_size")).first()[0] or 0
    if not before:
        return dealt.select(*sources.columns, F.lit(0.0).alias("target"))
    within = Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))
    start = F.create_map(*[F.lit(v) for pair in starts.items() for v in pair])[F.col("range")]
    place = F.row_number().over(within) - 1 + start
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    ranked = stage(dealt.withColumn("weight", weight.cast("double")), "mix-weights")
    limit = most * F.col("source_size")
    level = 0.0
    while True:
        # the level only rises, so a source that has reached its limit stays there
        full = F.col("weight") * level > limit
        facts = ranked.agg(
            F.sum(F.when(full, limit)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if not facts["weight"]:
            break
        risen = max(level, (share * total - (facts["full"] or 0.0)) / facts["weight"])
        if risen == level:
            break
        level = risen
    return ranked.select(*sources.columns, F.least(F.col("weight") * level, limit).alias("target"))


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(source, id, text_hash, size, n, copies, source_size, target): how often documents are copied.

    One row stands for the `n` rows that are alike in source, id and text; `copies` is the number of
    copies of them together.  size: words of the text (null or empty: 0).  Each source's words in copies
    miss its target by less than the size of one document; no row is copied more often than `most`,
    rounded up.  A null source is one more source.  Other columns are not looked at; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    units = stage(
        docs.select(
            F.col(source_col).alias("source"),
            F.col(id_col).alias("id"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text).alias("text_hash"),
        )
        .groupBy("source", "id", "size", "text_hash")
        .agg(F.count(F.lit(1)).alias("n")),
        "mix-units",
    )
    sources = stage(
        units.groupBy("source").agg(
            F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units")
        ),
        "mix-sources",
    )
    targets = stage(_targets(sources, list(weights), share, most), "mix-targets")
    kind = _ITEM.format(id=units.schema["id"].dataType.simpleString())

    shared = F.col("target") / F.col("source_size")
    expected = F.when(
        F.col("source_size") > 0, F.least(shared, F.lit(float(most))) * F.col("n")
    ).otherwise(0.0)
    drawn = join_by_key(
        units, targets.withColumn("rows_of_source", F.col("units")), "source", "units"
    ).withColumn("expected", expected)
    item = F.struct(
        (-F.col("size")).alias("falling"),
        F.xxhash64(F.lit(seed), "id", "text_hash", "size").alias("tie"),
        "id", "text_hash", "n",
        F.floor("expected").alias("copies"),
        ((F.col("expected") - F.floor("expected")) * F.col("size")).alias("mass"),
    ).cast(kind)
    chunks = F.ceil(F.col("rows_of_source") / GROUP)
    drawn = stage(
        drawn.select(
            "source", item.alias("item"), chunks.alias("chunks"),
            F.pmod(F.xxhash64(F.lit(seed + 1), "id", "text_hash", "size"), chunks).alias("chunk"),
        ),
        "mix-drawn",
    )
    whole = _is_whole(F.col("item"))
    finished = [drawn.filter(whole).select("source", "item")]
    open_items = drawn.filter(~whole).select("source", "chunk", "item")
    waiting = open_items.filter("chunk = 0")
    left = open_items.filter("chunk > 0")
    groups = drawn.agg(F.max("chunks")).first()[0] or 0
    level = 0
    while groups > 1:
        settled = stage(_settle(left, kind, seed + 2), f"mix-level-{level}")
        finished.append(settled.select("source", F.explode("done").alias("item")))
        # chunk 0 is the last level's, so groups are counted from 1
        groups = ceil_div(groups - 1, GROUP)
        left = settled.select(
            "source", F.when(F.lit(groups > 1), F.floor((F.col("chunk") - 1) / GROUP) + 1).otherwise(0).alias("chunk"),
            F.col("rest").alias("item"),
        )
        level += 1
    top = stage(_settle(waiting.unionByName(left) if level else waiting, kind, seed + 2), "mix-top")
    finished.append(top.select("source", F.explode("done").alias("item")))
    finished.append(top.select("source", F.col("rest").alias("item")))
    done = finished[0]
    for part in finished[1:]:
        done = done.unionByName(part)
    # what is left of a fraction at the very end falls to one side by chance
    size = -F.col("item.falling")
    last = F.col("item.copies") + (
        (size > 0) & (_chance(seed + 3, F.col("item.tie")) * size < F.col("item.mass"))
    ).cast("long")
    done = stage(
        done.filter(F.col("item").isNotNull()).select(
            "source", F.col("item.id").alias("id"), F.col("item.text_hash").alias("text_hash"),
            size.alias("size"), F.col("item.n").alias("n"), last.alias("copies"),
        ),
        "mix-done",
    )
    return join_by_key(done, targets, "source", "units")


def per_row(plan: DataFrame) -> DataFrame:
    """One row for each document row of a plan, with `copies` of its own.

    The copies of equal rows differ by one at most.
    """
    each, more = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    blocks = plan.withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))
    )
    first = F.col("block") * BLOCK
    last = F.least(F.col("n"), first + BLOCK) - 1
    return (
        blocks.withColumn("k", F.explode(F.sequence(first, last)))
        .withColumn("copies", each + (F.col("k") < more).cast("long"))
        .drop("block", "k", "n")
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The rows of `docs` with all their columns, each as often as the mix copies it."""
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    plan = plan_mix(docs, **names, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.col(source_col), F.lit("/"), F.col(id_col), F.lit("/"), F.xxhash64(text))
    rows = stage(
        docs.select(
            F.struct("*").alias("row"), key.alias("unit"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "mix-rows",
    )
    units = stage(
        plan.select(
            F.xxhash64("source", F.lit("/"), "id", F.lit("/"), "text_hash").alias("unit"), "n",
            F.col("n").alias("alike"), "copies",
        ),
        "mix-plan",
    )
    found = stage(join_by_key(rows, units, "unit", "n"), "mix-found")
    alone = found.filter("alike = 1").withColumn("k", F.lit(0).cast("long"))
    several = numbered(found.filter("alike > 1"), ["unit"], ["row_no"], "k")
    times = F.floor(F.col("copies") / F.col("alike")) + (
        F.col("k") < F.col("copies") % F.col("alike")
    ).cast("long")
    return (
        alone.unionByName(several)
        .withColumn("times", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
        .select("row.*")
    )
