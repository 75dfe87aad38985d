"""op1, op8 and op10 against plain Python."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rangeweave.llm import op1_chat, op8_pii, op10_quality
from tests.llm.helpers import AWKWARD, by_id, documents, prose


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    texts = [*AWKWARD, prose(1), prose(2, 200, 5), "a b c a b c d", "# <b> | & $ % *" * 9, "a a a a a"]
    docs = documents(spark, texts)
    got = by_id(op10_quality.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {i: quality(t) for i, t in enumerate(texts)}


def test_bad_host_goes_and_null_host_stays(spark):
    good, bad = [prose(i, 80, 10_000) for i in range(40)], ["short"] * 400
    rows = [(i, t, "en", "good.example", 0) for i, t in enumerate(good)] + [(100 + i, t, "en", "bad.example", 0) for i, t in enumerate([*bad, prose(99, 80, 10_000)])]
    rows += [(900, prose(7, 80, 10_000), "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {i for i, (k,) in by_id(op10_quality.judge(docs), "kept").items() if k}
    assert kept == {*range(40), 900}
    assert {r["doc_id"] for r in op10_quality.filter_documents(docs).collect()} == kept
    assert op10_quality.filter_documents(docs).columns == docs.columns


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_host_verdicts_against_sql(spark, tmp_path, seed):
    """Hosts of many sizes and rates, some of which reject documents that pass their own rules; null hosts and no hosts."""
    r = random.Random(seed)
    rows, k = [], 0
    for h in range(40):
        rate = r.choice([0.0, 0.3, 0.75, 0.82, 0.9, 1.0])
        for _ in range(r.choice([1, 2, 5, 30, 120])):
            k += 1
            rows.append((k, "too short" if r.random() < rate else prose(k, 60, 10_000), f"h{h}.example" if h else None))
    for part, decides in ((rows, True), (rows[:0], False), ([(i, "x", "one") for i in range(9)], False)):
        path = str(tmp_path / f"documents-{len(part)}")
        spark.createDataFrame(part, "doc_id long, text string, source string").coalesce(1).write.parquet(path)
        got = op10_quality.judge(spark.read.parquet(path))
        names = got.columns
        sql = op10_quality.SQL.replace("FROM documents", f"FROM read_parquet('{path}/*.parquet')")
        want = duckdb.connect().execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
        assert (got.where("NOT base_failed AND NOT kept").count() > 0) == decides


def test_quality_clashing_columns_and_empty(spark):
    docs = documents(spark, [prose(1, 80, 10_000)] * 2).withColumnsRenamed({"lang": "host", "n_chars": "host_docs"})
    names = ["__t", "__words", "__host", "__name", "__q", "__row", "__hashes", "__lines", "failed", "c0", "c1", "a.b"]
    docs = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    kept = op10_quality.filter_documents(docs)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
    assert op10_quality.judge(docs.limit(0)).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_pii(spark):
    texts = [
        *AWKWARD,
        "a@b.c+d@e.f é😀 x.y@z.w.v, mail me@localhost or %@a.b",
        "ip 1.2.3.4.5.6.7.8 and 999.1.1.1 000255.0.0.1 256.1.1.1 12.12.12",
        "card 4111 1111 1111 1111 or 4111-1111-1111-1111; 4111111111111112",
        "call +1 (743) 555-3824. +12 +1.2.3.4.5.6.7.8 +++1 1 1 1 1 1 1 1",
        " ".join(f"u{i}@example.com" for i in range(700)),
        "pay to account GB82 WEST 1234 5698 7654 32 or DE89370400440532013000 not DE88370400440532013000",
        "1" * 20000,
        "a" * 20000 + "@",
    ]
    got = by_id(op8_pii.query_rows(documents(spark, texts)), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in enumerate(texts):
        want = base_spans(t)
        n = Counter(s.split(":")[0] for s in want)
        assert got[i][:4] == (n["email"], n["ip"], n["card"], n["phone"])
        assert got[i][4] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in got[i][5].split(",") if s and not s.startswith("iban")] == want
    assert got[14][5] == "iban:15:42,iban:46:68"


def test_pii_context_and_empty(spark):
    docs = documents(spark, ["please call +1 743 555 3824", "xxxxxx xxxx +1 743 555 3824"])
    scores = {i: [s["score"] for s in p] for i, (p,) in by_id(op8_pii.find(docs), "pii").items()}
    assert scores == {0: [70], 1: [50]}
    assert op8_pii.query_rows(docs.limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def chats(spark, conversations):
    return spark.createDataFrame([(c, k, *t) for c, turns in conversations for k, t in enumerate(turns)], TURNS)


def test_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "x")]
    log = chats(spark, [(1, a[:2]), (2, a[:3]), (3, a), (4, a), (5, a[:1] + [("user", "other")]), (None, a), (6, [("user", "hi")])])
    got = {(r["conv_id"], r["part"]): (r["n_turns"], r["text"]) for r in op1_chat.render(log.union(log)).collect()}
    assert set(got) == {(3, 0), (5, 0)}
    assert got[5, 0] == (2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\nother<|im_end|>\n")
    assert got[3, 0][1].endswith("<|im_start|>user\n<|im_end|>\n<|im_start|>\nx<|im_end|>\n")


def test_long_conversations_are_cut_in_parts(spark):
    turns = [("user", f"t{i}") for i in range(1300)]
    log = chats(spark, [(1, turns), (2, turns[:1200]), (3, [*turns[:700], ("user", "z")])])
    got = {(r["conv_id"], r["part"]): r["n_turns"] for r in op1_chat.render(log).collect()}
    assert got == {(1, 0): 512, (1, 1): 512, (1, 2): 276, (3, 0): 512, (3, 1): 189}


def test_chat_extra_columns_ties_and_empty(spark):
    log = spark.createDataFrame([(1, None, "user", "b", "c"), (1, 5, "user", "y", "d"), (1, 5, "user", "x", "e")], "conv_id long, turn long, role string, text string, pos string")
    assert [r["text"] for r in op1_chat.render(log).collect()] == ["<|im_start|>user\nb<|im_end|>\n<|im_start|>user\nx<|im_end|>\n<|im_start|>user\ny<|im_end|>\n"]
    assert op1_chat.render(log.limit(0)).count() == 0
