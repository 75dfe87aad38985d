"""Personal data (DataFrame functions only): patterns propose spans, checksums confirm them, context sets the score.

Kinds, in the order of the results: email, ip, card, phone, and of this method's own iban (mod-97). Matches are
leftmost and do not overlap within a kind; a match that fails its check is dropped and its text isn't tried again.
A span's score is its kind's start value, raised by ``CONTEXT_BONUS`` where a word of its kind stands within
``CONTEXT_CHARS`` characters before or after it, not beyond the neighbouring proposals of its kind.

Edge cases: a null text counts as empty. A document without spans has counts of zero, the SHA-256 of the empty string
and empty lists. Repeated rows and null ids give a row each. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.llm.common import table, whole

# Possessive runs and starts bound to the edge of a run (or the end of the last match) give the same matches as the
# plain patterns, in time linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]++|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
}
BASE = ("email", "ip", "card", "phone")
#: Without this character a text has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
START_SCORE = {"email": 70, "ip": 50, "card": 70, "phone": 50, "iban": 80}
CONTEXT_BONUS, CONTEXT_CHARS = 20, 40
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|login|address",
    "card": "card|credit|debit|visa|pay|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer|bic",
}
#: Spans are placed by sums over blocks of so many, so that work stays near linear in their number.
BLOCK = 128
_SPAN = "struct<start:int,end:int,hit:string,before:string,after:string>"


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit,before,after>> of all matches; places in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(hits)
    steps = F.zip_with(
        F.zip_with(F.slice(gaps, 1, n), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), F.right(g, F.lit(CONTEXT_CHARS)).alias("before"), h.alias("hit"))),
        F.slice(gaps, 2, n),
        lambda s, g: s.withField("after", F.left(g, F.lit(CONTEXT_CHARS))),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
    placed = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out")),
        lambda a, block: F.aggregate(
            block,
            F.struct(a["at"].alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")),
            lambda c, x: F.struct(
                (c["at"] + x["gap"] + x["len"]).alias("at"),
                F.concat(
                    c["out"],
                    F.array(F.struct((c["at"] + x["gap"]).alias("start"), (c["at"] + x["gap"] + x["len"]).alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))),
                ).cast(f"array<{_SPAN}>").alias("out"),
            ),
            lambda c: F.struct(c["at"].alias("at"), F.concat(a["out"], F.array(c["out"])).alias("out")),
        ),
        lambda a: F.flatten(a["out"]),
    )
    return F.when(n > 0, placed).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(code: Column) -> Column:
    """The code with its first four characters moved to the end, letters as 10 to 35, leaves 1 when divided by 97."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest, i):
        o = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(o >= 65, rest * 100 + (o - 55)).otherwise(rest * 10 + (o - 48)) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step) == 1


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(hit, r"\."), lambda p: F.right(p, F.lit(3)).cast("int") <= 255
        )
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        code = F.translate(hit, " ", "")
        return F.when(F.length(code).between(15, 34), _mod97(code)).otherwise(False)
    return F.lit(True)


def _of_kind(text: Column, kind: str) -> Column:
    """array<struct<kind,start,end,score>> of the confirmed spans of a kind, by start."""
    near = rf"(?i)\b(?:{CONTEXT[kind]})\b"
    kept = F.filter(_spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["hit"]))
    out = F.transform(
        kept,
        lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (START_SCORE[kind] + F.when(s["before"].rlike(near) | s["after"].rlike(near), CONTEXT_BONUS).otherwise(0)).alias("score"),
        ),
    )
    if kind in NEEDS:
        out = F.when(F.contains(text, F.lit(NEEDS[kind])), out).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:int>>"))
    return out


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pii): the confirmed spans of every document, by kind as listed, then start; scores in percent."""
    at = docs.select("doc_id", whole(F.col(text)).alias("__t"))
    return at.select("doc_id", *[_of_kind(F.col("__t"), k).alias(k) for k in PATTERNS]).select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in PATTERNS], F.concat(*[F.col(k) for k in BASE]).alias("base"), F.concat(*[F.col(k) for k in PATTERNS]).alias("pii")
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_rows(table(spark, sf_dir, "documents"))


def query_rows(docs: DataFrame) -> DataFrame:
    """The counts and digests of what :func:`find` finds."""
    return find(docs).select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"),
        F.col("n_iban"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}([A-Z0-9]+|(\x20[A-Z0-9]{4}){2,7}(\x20[A-Z0-9]{1,3})?)",
}
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_CODE = "replace(hit, ' ', '')"
_SQL_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR ('0' || right(p, 3))::INT > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN reverse({_DIGITS})[i]::INT * (2 - i % 2) > 9 THEN reverse({_DIGITS})[i]::INT * 2 - 9 ELSE reverse({_DIGITS})[i]::INT * (2 - i % 2) END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": f"length({_CODE}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(range(1, length({_CODE}) + 1), lambda i: CASE WHEN ({_CODE}[5:] || {_CODE}[:4])[i] >= 'A' THEN ascii(({_CODE}[5:] || {_CODE}[:4])[i]) - 55 ELSE ({_CODE}[5:] || {_CODE}[:4])[i]::INT END)), lambda r, x: CASE WHEN x >= 10 THEN (r * 100 + x) % 97 ELSE (r * 10 + x) % 97 END) = 1",
}
_PROPOSED = " UNION ALL ".join(
    f"SELECT rid, '{k}' AS kind, {o} AS o, regexp_extract_all(t, '{p}') AS hs, regexp_split_to_array(t, '{p}') AS gs FROM d" for o, (k, p) in enumerate(_SQL_PATTERNS.items())
)
_VALID = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SQL_VALID.items())
_NEAR = " ".join(f"WHEN '{k}' THEN regexp_matches(x, '(?i)\\b(?:{v})\\b')" for k, v in CONTEXT.items())
_START = " ".join(f"WHEN '{k}' THEN {v}" for k, v in START_SCORE.items())
_IS_BASE = ", ".join(f"'{k}'" for k in BASE)
_LIST = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start)"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({_PROPOSED}),
e AS (SELECT rid, kind, o, hs, gs, unnest(range(1, len(hs) + 1)) AS i FROM k WHERE len(hs) > 0),
s AS (SELECT rid, kind, o, hs[i] AS hit, right(gs[i], {CONTEXT_CHARS}) || chr(10) || left(gs[i + 1], {CONTEXT_CHARS}) AS x,
  (list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hs[1:i - 1], lambda h: length(h))), 0))::BIGINT AS start FROM e),
v AS (SELECT *, start + length(hit) AS stop, CASE kind {_START} END + CASE WHEN CASE kind {_NEAR} END THEN {CONTEXT_BONUS} ELSE 0 END AS score
  FROM s WHERE CASE kind {_VALID} END),
a AS (SELECT rid, {_LIST} FILTER (kind IN ({_IS_BASE})), '') AS base, {_LIST}, '') AS spans, string_agg(score::VARCHAR, ',' ORDER BY o, start) AS scores,
  {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in PATTERNS)} FROM v GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_iban, 0)::BIGINT AS n_iban, coalesce(scores, '') AS scores
FROM d LEFT JOIN a ON d.rid = a.rid
"""
