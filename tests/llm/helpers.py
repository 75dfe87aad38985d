"""Small tables of documents with the awkward cases."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    """A documents table; ``ids`` default to places in ``texts``."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], COLUMNS)


def prose(seed, words=60, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


AWKWARD = [None, "", " \n\t ", "x", "éé ß 😀 中文", "a" * 5000, "line\n\n\nline\r\nLine", "\x00 \x0b \x1c \x85 \xa0 end", "1 " * 3000]


def by_id(frame, *columns):
    rows = frame.select("doc_id", *columns).collect()
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}
