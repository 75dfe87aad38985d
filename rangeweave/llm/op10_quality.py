"""Quality rules with host-level verdicts (DataFrame functions only).

Rules are measured per document. Their failures are then summed by host (``source``); each host's failure rate is
shrunk towards the corpus rate with a beta prior fitted to all hosts by moments; a host whose shrunk rate reaches
``host_limit`` is rejected, and that verdict is joined back to its documents. 3-word windows are compared by 64-bit hashes.

Edge cases: a null text counts as empty and fails the rules. A null host has no verdict: its documents are judged by
their own rules. Repeated rows are judged each by itself and all count for their host. :func:`filter_documents` keeps
extra columns whatever their names; :func:`judge` returns only its own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.llm.common import SPACES, table, whole, written

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: Percent of the words that may lie in repeated 3-word windows.
MAX_REPEAT = 50
#: Shrunk failure rate from which a host is rejected.
HOST_LIMIT = 0.8
#: Up to so many hosts (a row of a name and two counts each) verdicts are broadcast; beyond, both sides are shuffled.
BROADCAST_HOSTS = 20_000


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more. ``hashes``: one per 3-word window, in order.

    Hashes are sorted with their places, so equal windows meet; each repeated window then covers three words.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    met = F.zip_with(
        F.slice(placed, 1, F.size(hashes) - 1),
        F.slice(placed, 2, F.size(hashes) - 1),
        lambda p, q: F.when(p["h"] == q["h"], F.array(p["i"], q["i"])).otherwise(F.array().cast("array<int>")),
    )
    places = F.sort_array(F.array_distinct(F.flatten(met)))
    return F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a struct ``__q`` of the measures and the base verdict."""
    t, words, hashes = F.col("__t"), F.col("__words"), F.col("__hashes")
    n = F.size(words) - 2
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    measured = (
        docs.withColumn("__t", whole(F.col(text)))
        .withColumn("__words", F.filter(F.split("__t", SPACES, -1), lambda w: w != ""))
        .withColumn(
            "__hashes",
            F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
                F.zip_with(
                    F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                    F.slice(words, 3, n),
                    lambda p, c: F.xxhash64(p["a"], p["b"], c),
                )
            ),
        )
        .withColumn("__lines", lines)
        .withColumn(
            "__q",
            F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                F.length(F.translate(t, WHITE, "")).cast("bigint").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
                (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
                F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(_covered(hashes)).alias("n_repeat_words"),
            ),
        )
    )
    q = F.col("__q")
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT * q["n_words"])
    return measured.withColumn("__q", q.withField("base_failed", failed)).drop("__t", "__words", "__hashes", "__lines")


def host_verdicts(judged: DataFrame, host: str, failed: str, host_limit: float) -> DataFrame:
    """(host, host_docs, host_failures, host_kept), one row per host that is not null.

    The prior's mean is the corpus rate m. Its strength M is that at which binomial draws from it would spread as the
    hosts' rates do: with S the mean square of a host's rate about m, weighted by documents, N documents and K hosts,
    r = (S / (m (1 - m)) - (K - 1) / N) / (1 - sum n^2 / N^2 - (K - 1) / N) and M = 1 / r - 1, held within 1 and
    1,000,000 (which it is where hosts spread no more than chance lets them). So alpha = mM and beta = (1 - m)M.
    """
    n, f = F.col("host_docs"), F.col("host_failures")
    hosts = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("bigint")).alias("host_failures")
    )
    total, share = F.col("n"), F.col("m")
    prior = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.sum(n.cast("double") * n).alias("nn"), F.count(F.lit(1)).alias("k"))
    prior = prior.withColumn("m", F.col("f") / total).withColumn("noise", (F.col("k") - 1) / total)
    above = F.when((share > 0) & (share < 1), (F.col("ff") / total - share * share) / (share * (1 - share)) - F.col("noise"))
    room = 1 - F.col("nn") / total / total - F.col("noise")
    prior = prior.select("m", F.when((above > 0) & (room > 0), F.greatest(F.lit(1.0), F.least(F.lit(1e6), room / above - 1))).otherwise(1e6).alias("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select(  # the prior is one row
        "host", "host_docs", "host_failures", ((f + F.col("m") * F.col("strength")) / (n + F.col("strength")) < host_limit).alias("host_kept")
    )


def _with_verdicts(judged: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    side = hosts.select(F.struct("host_docs", "host_failures", "host_kept").alias("__host"), F.col("host").alias("__name"))
    if hosts.count() <= BROADCAST_HOSTS:
        side = F.broadcast(side)
    return judged.join(side, F.col(host) == F.col("__name"), "left").drop("__name")


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: its measures, its host's counts, and ``kept``."""
    judged = written(measure(docs.select("doc_id", F.col("source").alias("__source"), "text")).select("doc_id", "__source", "__q.*"))
    hosts = written(host_verdicts(judged, "__source", "base_failed", host_limit))
    return _with_verdicts(judged, hosts, "__source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("__host.host_kept", F.lit(True))).alias("kept"),
        F.col("__host.host_docs").alias("host_docs"), F.col("__host.host_failures").alias("host_failures"),
    )


def filter_documents(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass their own rules and whose host isn't rejected, with the columns of ``docs``.

    Rules are measured once; the rows are written with their verdict (those that fail without their text) and wait there
    for the hosts'.
    """
    host, text = (f"c{docs.columns.index(c)}" for c in ("source", "text"))
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # so that no name clashes
    judged = measure(plain, text).withColumn("failed", F.col("__q.base_failed")).drop("__q")
    judged = written(judged.withColumn(text, F.when(~F.col("failed"), F.col(text))))
    hosts = written(host_verdicts(judged, host, "failed", host_limit))
    kept = _with_verdicts(judged.where(~F.col("failed")), hosts, host).where(F.coalesce("__host.host_kept", F.lit(True)))
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g3 AS (SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS k FROM g),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g3) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.rid = cov.rid),
j AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*)::BIGINT AS n, sum(base_failed::BIGINT)::BIGINT AS f FROM j WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(n) AS n, sum(f) / sum(n) AS m, sum(f::DOUBLE * f / n) AS ff, sum(n::DOUBLE * n) AS nn, (count(*) - 1) / sum(n) AS noise FROM h),
q AS (SELECT m, CASE WHEN m > 0 AND m < 1 THEN (ff / n - m * m) / (m * (1 - m)) - noise END AS above, 1 - nn / n / n - noise AS room FROM p),
s AS (SELECT m, CASE WHEN above > 0 AND room > 0 THEN greatest(1.0, least(1e6, room / above - 1)) ELSE 1e6 END AS strength FROM q),
k AS (SELECT source, n, f, (f + m * strength) / (n + strength) < {HOST_LIMIT} AS ok FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(k.ok, true) AS kept, k.n AS host_docs, k.f AS host_failures
FROM j LEFT JOIN k ON j.source = k.source
"""
