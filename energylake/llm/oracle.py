"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others need a tokenizer, a hash that DuckDB lacks, a packing or a trained
model; they are tested against brute force in tests/llm.
"""

from __future__ import annotations

from .quality import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, WINDOW

GAP = r"[\x20\x09-\x0D]+"


def _verdict() -> str:
    parts = []
    for r in RULES:
        good = []
        if r.least is not None:
            good.append(f"{r.count} >= {r.per} * {r.least}")
        if r.most is not None:
            good.append(f"{r.count} <= {r.per} * {r.most}")
        parts.append(f"({' AND '.join(good)} OR n_words < {r.from_words})")
    return " AND ".join(parts)


QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '{GAP}'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
),
twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
),
covered AS (
  SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM (
    SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS n
    FROM twice
  ) GROUP BY doc_id
),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '{GAP}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_echoes,
    len(list_filter(ws, lambda x: lower(x) IN ({', '.join(repr(x) for x in STOP_WORDS)}))) AS n_stop_words
  FROM w LEFT JOIN covered USING (doc_id)
),
b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_verdict()} AS kept
FROM b
"""

TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score,
    row_number() OVER (
      PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, v.e) DESC, v.vec_id
    )::INTEGER AS rank
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 50 = 0
) WHERE rank <= 5
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(length({_DIGITS})), lambda k:
  CASE WHEN k % 2 = 0 THEN substr({_DIGITS}, length({_DIGITS}) - k, 1)::INT
       ELSE (substr({_DIGITS}, length({_DIGITS}) - k, 1)::INT * 2) // 10
          + (substr({_DIGITS}, length({_DIGITS}) - k, 1)::INT * 2) % 10 END)) % 10 = 0"""
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "list_max(list_transform(string_split(m, '.'), lambda p: p::HUGEINT)) <= 255",
    ),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
}


def _pii() -> str:
    """The base kinds.  The tables hold no spans of the added kinds; tests cover those."""
    steps = ["WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    for kind, (pattern, good) in _KINDS.items():
        steps.append(f"""{kind}_all AS (
  SELECT doc_id, g, ms, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS ms FROM d
  )
),
{kind}_at AS (
  SELECT doc_id, ms[i] AS m,
    list_sum(list_transform(g[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM {kind}_all
),
{kind}_ok AS (
  SELECT doc_id, count(*) AS n, string_agg('{kind}:' || s || ':' || (s + length(m)), ',' ORDER BY s) AS spans
  FROM {kind}_at WHERE {good} GROUP BY doc_id
)""")
    names = list(_KINDS)
    joined = "concat_ws(',', " + ", ".join(f"{k}_ok.spans" for k in names) + ")"
    joins = "\n".join(f"LEFT JOIN {k}_ok ON {k}_ok.doc_id = d.doc_id" for k in names)
    counts = ", ".join(f"coalesce({k}_ok.n, 0)::BIGINT AS n_{k}" for k in names)
    return (
        ",\n".join(steps)
        + f"\nSELECT d.doc_id, {counts}, sha256({joined}) AS base_sha256, {joined} AS spans\nFROM d\n{joins}"
    )


def _grid_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry of its codebook, in whole numbers."""
    steps = [
        """WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""p AS (
  SELECT vec_id, label, part, e[part * (len(e) // {parts}) + 1:(part + 1) * (len(e) // {parts})] AS x
  FROM k, range({parts}) AS r(part)
)""",
        f"""b0 AS (
  SELECT part, entry, x FROM p JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}
  ) USING (vec_id)
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
  SELECT vec_id, label, part, p.x, entry,
    list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) ** 2))::BIGINT AS d
  FROM p JOIN b{r} AS b USING (part)
),
a{r} AS (
  SELECT vec_id, label, part, any_value(x) AS x, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d
  FROM d{r} GROUP BY vec_id, label, part
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT part, entry, list(v ORDER BY i) AS x FROM (
    SELECT part, entry, i, floor(sum(x[i]) / count(*))::BIGINT AS v
    FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{r})
    GROUP BY part, entry, i
  ) GROUP BY part, entry
),
b{r + 1} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x
  FROM b{r} AS b LEFT JOIN m{r} AS m ON m.part = b.part AND m.entry = b.entry
)""")
    return ",\n".join(steps) + f""",
h AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
),
c AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code,
    sum(d)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c, h
"""


LLM_ORACLE: dict[str, str] = {
    "op8_quality": QUALITY,
    "op9_topk": TOPK,
    "op10_pii": _pii(),
    "op11_grid_codes": _grid_codes(),
}
