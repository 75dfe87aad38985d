"""Connected components: files of the checkpoints, and groups against a plain walk."""

import random

import pytest

from rangeweave.llm import components


@pytest.mark.parametrize("rows", [10_000, 40])
def test_checkpoints_have_as_many_parts_as_links_fill(spark, monkeypatch, rows):
    monkeypatch.setattr(components, "ROWS", rows)
    r = random.Random(3)
    links = [(r.randrange(500), r.randrange(500)) for _ in range(300)] + [(k, k + 1) for k in range(600, 650)] + [(7, 7), (None, 3)]
    parts, cut = [], components.cut

    def counted(df):
        out = cut(df)
        parts.append((out.count(), out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(components, "cut", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {x["node"]: x["root"] for x in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    assert len(parts) > 3
    assert all(n <= -(-known // rows) for (known, _), (_, n) in zip(parts[1:], parts[2:], strict=False))
    root = {x: x for pair in links if None not in pair and pair[0] != pair[1] for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root
