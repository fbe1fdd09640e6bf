"""SimHash against a plain version over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from gleaner.llm import queries, simhash


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows, radius=4):
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(rows):
        for b, g in rows[:i]:
            if (f ^ g).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k, _ in rows}


@pytest.mark.parametrize("text", ["", " \n", "one", "One two THREE", "a b c d", "a b c d e f g", "ß É x y z w v", "\x1c a\x0bb c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = plain_components([(r[0], plain_fingerprint(r[1] or "")) for r in sorted(rows)])
    got = queries.op5_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(int(r["fingerprint"], 16) == plain_fingerprint(t) for r in got for i, t in rows if i == r["doc_id"])


@pytest.mark.parametrize("hot", [0, 10_000])
def test_crowded_buckets_lose_no_link(spark, hot):
    r = random.Random(hot)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(700)} | {r.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_pairs(df, hot=hot).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    want, parent = plain_components([(f, f) for f in fps]), {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == want


def test_stars_join_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1001)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in simhash.stars(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 401)}, 1001: 1000}


def test_pivots_discard_and_keep():
    r = np.random.default_rng(3)
    fps = r.integers(0, 1 << 63, 200).astype(np.uint64)
    near = fps ^ np.uint64(0b1111)
    table = simhash.PivotTable(np.concatenate((fps, near)))
    i, j = np.divmod(np.arange(400 * 400), 400)
    want = np.flatnonzero(np.bitwise_count(table.fps[i] ^ table.fps[j]) <= 4)
    assert np.array_equal(np.sort(table.close(i, j, 4)), want)


def test_shares_nothing_but_segments():
    masks = simhash.bucket_masks((1 << 64) - 1, 4)
    assert len(masks) == 15 and all(any((m & d) == 0 for m in masks) for d in (sum(1 << b for b in random.Random(k).sample(range(64), 4)) for k in range(500)))


def test_pivot_tables_are_made_once_and_discard(spark):
    r = np.random.default_rng(8)
    fps = np.unique(r.integers(0, 1 << 63, 4000).astype(np.uint64))
    fps = np.concatenate((fps, fps[:300] ^ np.uint64(0b101)))
    df = simhash.with_pivots(spark.createDataFrame([(int(f),) for f in fps], "fp long"))
    for row in df.limit(50).collect():
        packed = np.array([row[t] for t in simhash.TABLE], np.int64).view(np.uint8)
        assert packed.tolist() == [(row["fp"] ^ int(p)).bit_count() for p in simhash.PIVOTS]
    # One bucket: the sorted coordinate and the others leave few pairs to compare, and lose none.
    distances = simhash.pivot_table(fps)
    order = np.argsort(distances[:, 0], kind="stable")
    table = simhash.PivotTable(fps[order], distances[order])
    a, b = simhash.link_sorted(np.zeros(len(fps), np.int64), table, 4)
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset((f, f ^ 5)) for f in fps[:300].tolist()}
    assert table.looked < 0.8 * len(fps) ** 2 / 2 and table.survived < 0.05 * table.looked


def test_large_keys_are_joined_apart(spark):
    rows = spark.range(20_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS k")
    unique = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 10 AS v")
    got = simhash.join_unique(rows, unique, "k", "n")
    assert sorted(got.columns) == ["id", "k", "v"] and got.count() == 20_000 and got.where("v <> k * 10").isEmpty()
