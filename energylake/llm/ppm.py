"""Language-model scores by prediction by partial matching over bytes.

The training texts' byte contexts form a trie of depth `ORDER`.  A symbol's probability is
taken from the longest context in the trie; a symbol that never followed it costs an
escape, estimated by the number of different symbols that did (method C), and is
looked up in the next shorter context, where all symbols of the longer one are
excluded from the counts.  Below the empty context all symbols left are equally likely.

Every context that occurs in a training text is part of the model, at every size of the corpus.  The trie is
a table for each length of context, partitioned by the context: a row for each symbol that followed, with
the counts of symbol and context.  What an escape costs follows from sums over the context's own rows and
those of the next shorter one.  A symbol that has followed its whole context needs no escape, so its code
length stands in the longest table; the most frequent of those, up to a fixed number, travel to the workers as
sorted arrays.  All other symbols of a text, with whatever contexts, are looked up by joins.

Beside the model stands a smoothed unigram model of words.  Counts of the most frequent words
travel to the workers, up to a fixed number of words; all rarer words are looked up by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import map_arrow

#: bytes of context
ORDER = 5
#: symbols in context whose code lengths every worker holds; all others are looked up
HOT = 1 << 22
#: bytes, and the mark that begins and ends a text
SYMBOLS = 257
MARK = 256
#: bits of a symbol in a code of several
BITS = 9
#: words whose counts every worker holds
FREQUENT = 1 << 17
#: words a task counts before it passes its counts on
HELD = 200_000
#: texts that are scored before their scores are passed on
SLICE = 500
#: bytes of text worked on at once
CHUNK = 1 << 20
#: different codes a task holds before it merges them
MERGE = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def symbol_stream(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, first, last) for runs of texts: `ORDER` marks stand before each text and
    after the last; a text's symbols, with the mark that ends it, are first to last - 1."""
    texts = texts.fill_null("")
    lengths = pa.compute.binary_length(texts).to_numpy().astype(np.int64)
    ends = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
        raw = "".join(texts.slice(i, j - i).to_pylist()).encode()
        own = lengths[i:j]
        marks = ORDER * np.arange(1, j - i + 1)
        stream = np.full(len(raw) + ORDER * (j - i + 1), MARK, np.int32)
        stream[np.arange(len(raw)) + np.repeat(marks, own)] = np.frombuffer(raw, np.uint8)
        first = np.cumsum(own) - own + marks
        yield stream, first, first + own + 1
        i = j


def codes_of(stream: np.ndarray) -> np.ndarray:
    """Number of each symbol together with the `ORDER` before it, from place `ORDER` on."""
    n = len(stream) - ORDER
    code = stream[:n].astype(np.int64)
    for k in range(1, ORDER + 1):
        code = code << BITS | stream[k : k + n]
    return code


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in parts])
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.concatenate([n for _, n in parts])[order]
    return codes[start], np.add.reduceat(counts, start)


def count_contexts(texts: DataFrame) -> DataFrame:
    """(code, n): how often each symbol followed each `ORDER` symbols in column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for stream, _, last in symbol_stream(batch.column(0)):
                # of the marks between texts only the one that ends a text is counted
                real = stream < MARK
                real[last - 1] = True
                parts.append(np.unique(codes_of(stream)[real[ORDER:]], return_counts=True))
                held += len(parts[-1][0])
                if held > MERGE:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > MERGE // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["code", "n"])
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(parts)], ["code", "n"])

    return map_arrow(texts.select("text"), run, "code long, n long").groupBy("code").agg(
        F.sum("n").alias("n")
    )


def _low(column: Column | str, symbols: int) -> Column:
    """The last symbols of a code."""
    column = F.col(column) if isinstance(column, str) else column
    return column.bitwiseAND((1 << BITS * symbols) - 1)


def _context(column: Column | str) -> Column:
    return F.shiftright(column, BITS)


def with_contexts(counts: DataFrame) -> DataFrame:
    """(code, n, total, kinds): symbols after the code's context, and how many different ones."""
    own = Window.partitionBy(_context("code"))
    return counts.select(
        "code", "n", F.sum("n").over(own).alias("total"), F.count(F.lit(1)).over(own).alias("kinds")
    )


def _weight(total: Column, kinds: Column, whole: Column) -> Column:
    """What counts are shares of: the symbols, and one escape for each kind unless all symbols were seen."""
    return total + F.when(whole, 0).otherwise(kinds)


class Model:
    """Tables of the trie, by length of context from 0 to `ORDER`.

    `symbols[k]`: code of k + 1 symbols, n, total, kinds (see `with_contexts`).  `contexts[k]`, from 1 on: a
    context of k symbols, its total and kinds, and those of the next shorter one with the symbols that followed the
    longer one left out (`rest`, `rest_kinds`, `rest_whole`): what an escape from the context leads to.
    """

    def __init__(self, texts: DataFrame):
        counts = stage(count_contexts(texts), "contexts")
        self.symbols: list[DataFrame] = []
        for k in range(ORDER, -1, -1):
            table = stage(with_contexts(counts), f"symbols-{k}")
            self.symbols.insert(0, table)
            counts = table.groupBy(_low("code", k).alias("code")).agg(F.sum("n").alias("n"))
        self.contexts: list[DataFrame | None] = [None]
        for k in range(1, ORDER + 1):
            shorter = self.symbols[k - 1].select(
                F.col("code").alias("shorter"), F.col("n").alias("n_shorter"),
                F.col("total").alias("total_shorter"), F.col("kinds").alias("kinds_shorter"),
            )
            # the symbols that followed the longer context: what an escape leaves out
            table = self.symbols[k].withColumn("shorter", _low("code", k)).join(shorter, "shorter")
            self.contexts.append(
                stage(
                    table.groupBy(_context("code").alias("context")).agg(
                        F.first("total").alias("total"),
                        F.first("kinds").alias("kinds"),
                        (F.first("total_shorter") - F.sum("n_shorter")).alias("rest"),
                        (F.first("kinds_shorter") - F.count(F.lit(1))).alias("rest_kinds"),
                        (F.first("kinds_shorter") == SYMBOLS).alias("rest_whole"),
                    ),
                    f"contexts-{k}",
                )
            )
        base = self.symbols[0].agg(F.first("total"), F.first("kinds")).first()
        self.total, self.kinds = base[0] or 0, base[1] or 0

    def hot(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and code lengths (log10) of the most frequent symbols in context, sorted by code."""
        table = self.symbols[ORDER]
        least = least_count(table, most)
        if least is None:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        weight = _weight(F.col("total"), F.col("kinds"), F.col("kinds") == SYMBOLS)
        found = (
            table.filter(F.col("n") >= least)
            .select("code", F.log10(F.col("n") / weight).cast("float").alias("length"))
            .toArrow()
        )
        codes, lengths = found.column("code").to_numpy(), found.column("length").to_numpy()
        order = np.argsort(codes)
        return codes[order], lengths[order]

    def lengths(self, codes: DataFrame) -> DataFrame:
        """(code, length): log10 probability of the last symbol of each code after the others."""
        rows = codes.select("code").distinct()
        for k in range(ORDER, -1, -1):
            seen = self.symbols[k].select(F.col("code").alias("_code"), F.col("n").alias(f"n{k}"))
            rows = rows.join(seen, _low("code", k + 1) == F.col("_code"), "left").drop("_code")
            if k:
                facts = self.contexts[k].select(
                    F.col("context").alias("_context"),
                    *[F.col(c).alias(f"{c}{k}") for c in ("total", "kinds", "rest", "rest_kinds", "rest_whole")],
                )
                own = _low(_context("code"), k)
                rows = rows.join(facts, own == F.col("_context"), "left").drop("_context")
        paid, found = F.lit(0.0), F.lit(None).cast("double")
        for k in range(ORDER, -1, -1):
            if k:
                total, kinds = F.col(f"total{k}"), F.col(f"kinds{k}")
            else:
                total, kinds = F.lit(self.total), F.lit(self.kinds)
            whole = kinds == SYMBOLS
            if k < ORDER:
                longer = F.col(f"total{k + 1}").isNotNull()
                whole = F.when(longer, F.col(f"rest_whole{k + 1}")).otherwise(whole)
                total = F.when(longer, F.col(f"rest{k + 1}")).otherwise(total)
                kinds = F.when(longer, F.col(f"rest_kinds{k + 1}")).otherwise(kinds)
            weight = _weight(total, kinds, whole)
            here = paid + F.log10(F.col(f"n{k}") / weight)
            found = F.coalesce(found, F.when(F.col(f"n{k}").isNotNull(), here))
            # without symbols of its own a context is passed over
            paid = paid + F.when(kinds > 0, F.log10(kinds / weight)).otherwise(0.0)
        unseen = paid - math.log10(max(1, SYMBOLS - self.kinds))
        return rows.select("code", F.coalesce(found, unseen).alias("length"))


def least_count(counts: DataFrame, most: int) -> int | None:
    """The least count of which at most `most` rows of column `n` have as much or more; None if there is none."""
    # bins of counts, eight to an octave: a few hundred rows
    level = F.floor(F.log2("n") * 8)
    bins = sorted(
        counts.groupBy(level.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")).collect(),
        key=lambda r: -r.bin,
    )
    total, least = 0, None
    for row in bins:
        total += row.rows
        if total > most:
            break
        least = row.n
    return least


def sums_of(
    texts: pa.Array, codes: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each text the sum of the known code lengths, and the codes that are not known, with their numbers."""
    scores, rare, times = [], [], []
    for stream, first, last in symbol_stream(texts):
        own, back = np.unique(codes_of(stream), return_inverse=True)
        at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
        known = codes[at] == own if len(codes) else np.zeros(len(own), bool)
        length = np.where(known, lengths[at], 0).astype(np.float64) if len(codes) else np.zeros(len(own))
        # from each text's first symbol to the mark after its end mark
        bounds = np.stack([first, last], axis=1).ravel() - ORDER
        scores.append(np.add.reduceat(length[back], bounds)[::2])
        left = ~known[back]
        for a, b in zip(first - ORDER, last - ORDER, strict=True):
            c, n = np.unique(own[back[a:b][left[a:b]]], return_counts=True)
            rare.append(c)
            times.append(n)
    return np.concatenate(scores) if scores else np.zeros(0), rare, times


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(held.keys()), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [words, pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return map_arrow(texts.select("text"), run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")
    )


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """All words above some count; the count is the least for which they are at most `most`."""
    least = least_count(counts, most)
    if least is None:
        return {}
    found = counts.filter(F.col("n") >= least).toArrow()
    words = found.column("word").cast(pa.binary()).to_pylist()
    return dict(zip(words, found.column("n").to_pylist(), strict=True))


def score(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Scores of all rows under models of the rows for which `held_out` is not true.

    `held_out` is a condition on the columns of `docs`.  Columns: `id_col`, held_out, n_tokens (words and one end), n_known (tokens seen in
    training), train_tokens, base_score (words, log10) and score (bytes, log10).  A null
    text counts as an empty one, which is its end alone; null and repeated ids are scored like any other;
    without training rows the models are uniform; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    training = rows.filter(~F.col("held_out"))
    counts = stage(count_words(training), "word-counts")
    n_docs = training.count()
    facts = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n = (facts[0] or 0) + n_docs
    v = facts[1] + (n_docs > 0)
    weight = math.log10(n + 0.5 * (v + 1))
    known = frequent_words(counts)
    shared_words = spark.sparkContext.broadcast(known)
    model = Model(training)
    shared_codes = spark.sparkContext.broadcast(model.hot(HOT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, (codes, lengths) = shared_words.value, shared_codes.value
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            scores, rare_codes, code_times = sums_of(batch.column("text"), codes, lengths)
            tokens, sure, base, rare, times = [], [], [], [], []
            for text in batch.column("text"):
                own = Counter(words_of(text.as_py()))
                found = {w: c for w in own if (c := frequent.get(w))}
                tokens.append(sum(own.values()) + 1)
                sure.append(sum(own[w] for w in found) + (n_docs > 0))
                base.append(
                    math.fsum(own[w] * (math.log10(c + 0.5) - weight) for w, c in found.items())
                    + math.log10(n_docs + 0.5)
                    - weight
                )
                left = own.keys() - found.keys()
                rare.append(list(left))
                times.append([own[w] for w in left])
            columns = [
                batch.column("id"), batch.column("held_out"), pa.array(tokens, pa.int64()),
                pa.array(sure, pa.int64()), pa.array(base, pa.float64()),
                pa.array(scores),
                pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                pa.array(times, pa.list_(pa.int64())),
                pa.array(rare_codes, pa.list_(pa.int64())),
                pa.array(code_times, pa.list_(pa.int64())),
            ]
            names = [
                "id", "held_out", "n_tokens", "sure", "base", "score", "rare", "times",
                "rare_codes", "code_times",
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, held_out boolean, n_tokens long, sure long, base double, score double, "
        "rare array<string>, times array<long>, rare_codes array<long>, code_times array<long>"
    )
    scored = stage(
        map_arrow(rows, run, schema).withColumn("row_no", F.monotonically_increasing_id()), "scored"
    )
    shared_words.unpersist()
    shared_codes.unpersist()
    least = F.lit(min(known.values(), default=1 << 62))
    looked_up = (
        scored.select("row_no", F.explode(F.arrays_zip("rare", "times")).alias("x"))
        .select("row_no", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
        .join(counts.filter(F.col("n") < least), "word", "left")
        .groupBy("row_no")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
            F.sum(
                F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - weight)
            ).alias("rest"),
        )
    )
    pairs = scored.select("row_no", F.explode(F.arrays_zip("rare_codes", "code_times")).alias("x")).select(
        "row_no", F.col("x.rare_codes").alias("code"), F.col("x.code_times").alias("times")
    )
    rare_lengths = stage(model.lengths(pairs), "rare-lengths")
    more_score = (
        pairs.join(rare_lengths, "code")
        .groupBy("row_no")
        .agg(F.sum(F.col("times") * F.col("length")).alias("more_score"))
    )
    whole = scored.drop("rare", "times", "rare_codes", "code_times")
    whole = whole.join(looked_up, "row_no", "left").join(more_score, "row_no", "left")
    return whole.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
