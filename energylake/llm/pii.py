"""Personal data: patterns propose spans, checksums confirm them, context weighs them.

Only Spark's own functions are used.  The regular expressions are written so
that no text makes them slow: repeats are possessive where that changes no match,
and a match that could begin inside a run of its own characters begins at the run's start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scan

#: score at which a proposed span counts
THRESHOLD = 1.0
#: characters before and after a span in which context words are looked for
CONTEXT = 40
#: length of an account number by country; other countries: any of the allowed lengths
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _email_ok(match: Column) -> Column:
    return F.lit(True)


def _ip_ok(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _card_ok(match: Column) -> Column:
    return let(
        _digits(match),
        lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d),
    )


def _phone_ok(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


def _iban_end(match: Column) -> Column:
    """Length of the account number that `match` begins with; null if there is none.

    Numbers leave 1 when, with country and check digits moved to the end and letters as 10 to
    35, they are divided by 97.  Every end of a word is tried that gives the country's length, or, for
    a country without one, a length from 15 to 34.
    """

    def mod97(code: Column) -> Column:
        turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
        return F.aggregate(
            F.split(turned, ""),
            F.lit(0),
            lambda rest, c: F.when(c == "", rest)
            .when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97)
            .otherwise((rest * 100 + F.ascii(c) - 55) % 97),
        )

    fixed = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])

    def right(end: Column, length: Column) -> Column:
        code = F.replace(F.substring(match, F.lit(1), end), F.lit(" "), F.lit(""))
        return (
            F.substring(match, end, F.lit(2)).rlike("^[A-Z0-9](?![A-Za-z0-9])")
            & F.when(length.isNull(), F.length(code).between(15, 34)).otherwise(F.length(code) == length)
            & (mod97(code) == 1)
        )

    ends = let(
        F.try_element_at(fixed, F.substring(match, 1, 2)),
        lambda length: F.filter(
            F.sequence(F.lit(15), F.greatest(F.lit(15), F.length(match))), lambda end: right(end, length)
        ),
    )
    return F.get(ends, F.lit(0))


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    `score` is what the pattern alone is worth; `check` confirms a match or drops
    it; a word of `context` shortly before or after the span adds `context_score`.  `needs` is a
    literal without which the pattern cannot match.

    With `end`, the pattern matches a span's first character and captures all that the span may
    cover; `end` gives the span's length, or null.
    """

    name: str
    pattern: str
    check: Callable[[Column], Column] | None = None
    end: Callable[[Column], Column] | None = None
    score: float = 1.0
    context: str | None = None
    context_score: float = 0.5
    needs: str | None = None


LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind(
        "email",
        rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        _email_ok,
        needs="@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _ip_ok, needs="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card_ok),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone_ok, needs="+"),
    # not of the base: their score needs a checksum or a word of context
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]",
        end=_iban_end,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        score=0.5,
        context=r"(?i)\b(?:ssn|social security|tax id)\b",
        needs="-",
    ),
)
BASE = ("email", "ip", "card", "phone")


def _reached(spans: Column) -> Column:
    """Where the spans taken before each one end; a span is taken that begins there or later."""
    return scan(
        spans,
        F.lit(0),
        lambda at, s: F.when(s["start"] >= at, s["end"]).otherwise(at),
        lambda at, s: at,
        "int",
    )


def spans_of(text: Column, kind: Kind) -> Column:
    """Array of (kind, start, end) in code points, end exclusive, in order of start.

    Matches are the leftmost ones that do not overlap.  What lies between them is what
    splitting by the same pattern leaves, so the lengths of both give the places.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    group = 1 if kind.end else 0
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(group))
    gaps = F.split(text, kind.pattern, -1)

    def near(gaps: Column) -> Column:
        """For each match, the text beside it without the matches: `CONTEXT` characters on
        both sides.  Gaps of a list, which have no letters or digits, take no room."""

        def wider(so_far: Column, gap: Column, joined: Column, side: Callable[[Column], Column]) -> Column:
            return F.when(gap.rlike("[\\p{L}\\p{N}]"), side(joined)).otherwise(so_far)

        def states(gaps: Column, step: Callable[[Column, Column], Column]) -> Column:
            return scan(gaps, F.lit(""), step, step, "string")

        before = states(
            F.slice(gaps, F.lit(1), F.size(gaps) - 1),
            lambda s, g: wider(s, g, F.concat_ws(" ", s, g), lambda t: F.right(t, F.lit(CONTEXT))),
        )
        after = states(
            F.slice(F.reverse(gaps), F.lit(1), F.size(gaps) - 1),
            lambda s, g: wider(s, g, F.concat_ws(" ", g, s), lambda t: F.left(t, F.lit(CONTEXT))),
        )
        return F.zip_with(before, F.reverse(after), lambda b, a: F.concat_ws(" | ", b, a))

    def scored(match: Column, beside: Column | None) -> Column:
        score = F.lit(kind.score)
        if beside is not None:
            score += F.when(beside.rlike(kind.context), kind.context_score).otherwise(0.0)
        return F.coalesce(kind.check(match) & (score >= THRESHOLD), F.lit(False))

    def span(at: Column, row: Column) -> Column:
        start = at + row["gap"]
        return F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            (start + row["length"]).alias("end"),
            row["good"].alias("good"),
        )

    def placed(found: Column) -> Column:
        def fields(gap: Column, taken: Column, length: Column, good: Column) -> Column:
            return F.struct(
                F.length(gap).alias("gap"), taken.alias("match"), length.alias("length"), good.alias("good")
            )

        def row(gap: Column, match: Column, beside: Column | None = None) -> Column:
            if kind.end:
                return let(kind.end(match), lambda n: fields(gap, F.lit(1), n, n.isNotNull()))
            return fields(gap, F.length(match), F.length(match), scored(match, beside))

        if kind.context:
            rows = let(
                gaps,
                lambda g: F.zip_with(
                    F.arrays_zip(F.slice(g, F.lit(1), F.size(found)).alias("gap"), near(g).alias("beside")),
                    found,
                    lambda x, m: row(x["gap"], m, x["beside"]),
                ),
            )
        else:
            rows = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: row(g, m))
        every = let(
            rows,
            lambda r: scan(
                r,
                F.lit(0),
                lambda at, row: at + row["gap"] + row["match"],
                span,
                "struct<kind:string,start:int,end:int,good:boolean>",
            ),
        )
        good = F.filter(every, lambda s: s["good"])
        if kind.end:
            # a span may cover the begin of another match
            good = let(
                good,
                lambda g: F.filter(
                    F.zip_with(g, _reached(g), lambda s, at: F.when(s["start"] >= at, s)),
                    lambda s: s.isNotNull(),
                ),
            )
        return F.transform(
            good, lambda s: F.struct(s["kind"], s["start"], s["end"])
        ).cast("array<struct<kind:string,start:int,end:int>>")

    possible = text.contains(kind.needs) if kind.needs else text.rlike("[0-9]")
    return F.when(
        possible, let(matches, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))
    ).otherwise(none)


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows of `docs` in a struct `row`, with the spans found in their texts.

    Columns: row, text (null: empty), one array of spans for each of `KINDS`.  An empty text has no spans; every
    row is looked at by itself; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text")
    ).select("row", "text", *[spans_of(F.col("text"), k).alias(k.name) for k in KINDS])


def report(found: DataFrame) -> DataFrame:
    """`find`'s rows with counts of the base kinds, a digest of their spans, and all spans."""
    base = F.concat(*[F.col(k) for k in BASE])
    every = F.concat(*[F.col(k.name) for k in KINDS])
    return found.select(
        "row",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with each span replaced by its kind in brackets; null texts stay null.

    Spans that overlap become one, named after the one that begins first.
    """
    found = find(docs, text_col)
    every = F.concat(*[F.col(k.name) for k in KINDS])

    def masked(spans: Column) -> Column:
        ordered = F.array_sort(
            F.transform(
                spans,
                lambda s: F.struct(
                    s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")
                ),
            )
        )
        # each span with the end of all before it
        rows = let(
            ordered,
            lambda o: scan(
                o,
                F.lit(0),
                lambda at, s: F.greatest(at, s["end"]),
                lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")),
                "struct<at:int,start:int,kind:string>",
            ),
        )
        parts = F.transform(
            F.filter(rows, lambda s: s["start"] >= s["at"]),
            lambda s: F.concat(
                F.substring(F.col("text"), s["at"] + 1, s["start"] - s["at"]),
                F.lit("["),
                F.upper(s["kind"]),
                F.lit("]"),
            ),
        )
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(
            F.array_join(parts, ""), F.substring(F.col("text"), last + 1, F.length("text"))
        )

    clean = let(every, lambda s: F.when(F.size(s) > 0, masked(s)).otherwise(F.col("text")))
    return found.withColumn(
        "clean", F.when(F.col(f"row.`{text_col}`").isNotNull(), clean)
    ).select(
        *[
            F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
