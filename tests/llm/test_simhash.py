import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import simhash
from corvane.llm.common import connected_components

DOCS = "doc_id long, text string"


def brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def texts():
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    out = [" ".join(r.choice(words, 60)) for _ in range(20)]
    out += [out[0], out[0], out[1].upper(), out[2] + " tail", "", None, "  \n", "one", "one two", "É É É", "x " * 5000]
    return out + [" ".join(out[3].split()[:-1] + ["zz"])] * 2


def test_against_brute_force(spark):
    t = texts()
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(t)), DOCS).withColumn("fp", F.lit(1))).collect()
    fps = [brute(x) for x in t]
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    near = [(i, j) for i, j in itertools.combinations(range(len(t)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert {r["doc_id"]: r["component_id"] for r in got} == components(near, range(len(t)))


def test_links_of_all_distances(spark):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(-(2**63), 2**63, 30)]
    flip = lambda x, *bits: (((x & (2**64 - 1)) ^ sum(1 << b for b in bits)) + 2**63) % 2**64 - 2**63
    fps = {*base, *(flip(x, 63) for x in base[:8]), *(flip(x, 5, 63) for x in base[4:14]), *(flip(x, 1, 2, 3) for x in base[12:20])}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df)).collect()}
    near = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert {x: roots.get(x, x) for x in fps} == components(near, fps)


def test_long_path_is_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_keep_first_and_edge_cases(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (2, "other words stand here now"), (2, "other words stand here now"), (None, "a b c d"), (9, None)]
    kept = simhash.keep_first(spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS + ", source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 2), (True, 9)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 200])
def test_fingerprint(n):
    t = " ".join(f"W{i % 7}" for i in range(n))
    assert simhash.fingerprint(t.encode()) % 2**64 == brute(t)


def test_keep_first_names_rows_by_text(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "quite another text stands in this row today"
    rows = [(3, a), (5, a), (5, b), (7, None), (8, ""), (7, b + " and more words"), (5, b)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], DOCS + ", sim_goes int")
    for few in (1000, 0):
        kept = simhash.keep_first(docs, broadcast_rows=few)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, a), (5, b), (7, None), (7, b + " and more words")], key=str)
    assert simhash.keep_first(spark.createDataFrame([], DOCS)).count() == 0
