"""op5's first look at candidates: loses none that is a leak, leaves few to read word by word."""

import random

import numpy as np
import pandas as pd

from rangeweave.llm import op5_decontamination as op5


def test_candidates_without_the_words_are_not_read(monkeypatch):
    """Passages of the items' own common words are near many items; only those that hold an item's weight are read."""
    r = random.Random(4)
    common = [f"c{k}" for k in range(12)]
    items = [(k, " ".join(r.choice(common) if r.random() < 0.5 else f"i{k}w{j}" for j in range(r.randrange(20, 60)))) for k in range(30)]
    texts = [" ".join(r.choice(common) if r.random() < 0.7 else f"i{r.randrange(30)}w{r.randrange(60)}" for _ in range(400)) for _ in range(20)]
    for k in range(10):  # some leaks: an item with a word in ten replaced
        texts[k] += " " + " ".join(w if r.random() < 0.9 else "other" for w in items[k][1].split())
    b = op5.Benchmark(items)
    b.weigh(np.where(np.isin(b.vocabulary, op5._hashes(" ".join(common))), 500, 3), 1000)
    b.project(np.linalg.qr(np.random.default_rng(1).standard_normal((len(b.vocabulary), 40)))[0])
    rows = pd.DataFrame({"t": [t.encode() for t in texts]})

    def search(cosine):
        found = pd.concat(list(op5._search(b, cosine, iter([rows]))))["leaks"]
        return [sorted((x["item_id"], x["score"]) for x in leaks) for leaks in found]

    read, same = [0], op5.Benchmark.same

    def counted(self, item, passage):
        read[0] += 1
        return same(self, item, passage)

    monkeypatch.setattr(op5.Benchmark, "same", counted)
    got = search(0.1)
    assert sum(map(len, got)) >= 8
    assert read[0] <= 10 * sum(map(len, got))
    # every passage and item, read word by word
    for leaks, text in zip(got, texts, strict=True):
        terms = b.look_up(op5._hashes(text))
        every = {}
        for k in range(len(items)):
            for at in range(0, len(terms), op5.SEGMENT):
                passage = terms[at : at + int(b.spans[k]) * op5.SEGMENT]
                if (share := same(b, k, passage[passage >= 0])) is not None:
                    every[k] = max(share, every.get(k, 0.0))
        assert {k for k, _ in leaks} <= set(every)
        assert {k for k, s in every.items() if s >= op5.SAME} <= {k for k, _ in leaks}


def test_holding_by_itself():
    """Against sets, for passages of every place and length; pairs are dealt in parts."""
    r = random.Random(9)
    items = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 30)))) for k in range(12)]
    b = op5.Benchmark(items)
    b.weigh(np.arange(len(b.vocabulary)), 500)
    terms, n = np.array([r.randrange(len(b.vocabulary)) for _ in range(400)]), 50
    segment = np.sort(np.array([r.randrange(n) for _ in terms]))
    pairs = [(at, min(n, at + s), k) for at in range(n) for s in (1, 3, 7) for k in range(12)] * 12
    at, stops, which = (np.array(x) for x in zip(*pairs, strict=True))
    got = op5._holding(b, np.sort(terms * n + segment), at, stops, which, n)
    assert 0 < got.sum() < len(got)
    for (a, s, k), g in zip(pairs[: 50 * 36], got, strict=False):
        held = set(terms[(segment >= a) & (segment < s)].tolist())
        share = sum(b.idf[t] for t in b.terms[k] if t in held)
        assert g == (share >= 0.6 * b.totals[k] - 1e-6)
