import html
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import forest, pivots, simhash, sitetree
from corvane.llm.pivots import local_labels

VEC = "vec_id long, embedding array<float>"
SF = "/root/testdata/sf0.001"


def vectors(n=1500, dim=64, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x[: n // 5] = x[0] + 0.08 * r.standard_normal((n // 5, dim))
    x[10] = x[11] = x[12]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def odd_rows():
    nan = float("nan")
    return [(9001, None), (9002, [0.0] * 64), (9003, [nan] * 64), (9004, [None] * 64), (9005, [1.0]), (9006, [])]


def test_forest_recall(spark):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd_rows()
    got = forest.nearest(spark.createDataFrame(rows, VEC).withColumn("score", F.lit(1)), every=20, k=20).toPandas()
    e = x.astype(np.float64)
    hit = 0
    for q in range(0, len(x), 20):
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        s = e @ e[q]
        assert np.allclose(own.score, s[own.vec_id], atol=1e-12) and (np.diff(own.score) <= 1e-15).all()
        s[q] = -9
        hit += len(set(np.argsort(-s)[:20]) & set(own.vec_id))
    assert hit / (20 * len(range(0, len(x), 20))) >= 0.9


def test_forest_small_cases(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0])], VEC)
    got = [tuple(r)[:3] for r in forest.nearest(few).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 3), (0, 3, 2)]
    assert forest.nearest(spark.createDataFrame([], VEC)).count() == 0


def test_forest_sharded(spark):
    x = vectors(400)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    v = forest.usable(rows)
    got = forest.search(v, v.where("id < 40"), 5, shard_rows=150, block_rows=15).toPandas()
    assert len(got) == 200 and not got.duplicated(["query_id", "vec_id"]).any()


def links_of(x, cosine=0.9):
    e = x.astype(np.float64)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    a = e @ e.T >= cosine
    i, j = np.nonzero(np.triu(a, 1))
    return a.sum(1) - 1, local_labels(len(x), i, j)


@pytest.mark.parametrize("block", [2048, 64])
def test_pivots_against_brute_force(spark, block):
    x = vectors(900, seed=7)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd_rows()
    got = pivots.near_duplicates(spark.createDataFrame(rows, VEC).withColumn("linked", F.lit(1)), block=block).toPandas().set_index("vec_id")
    n, label = links_of(x)
    assert (got.loc[range(len(x)), "n_links"].to_numpy() == n).mean() > 0.995
    assert (got.loc[range(len(x)), "component_id"].to_numpy() == label).all()
    assert (got.kept == (got.index == got.component_id)).all()
    assert (got.loc[9001:, "n_links"] == 0).all() and (got.loc[9001:].index == got.loc[9001:, "component_id"]).all()


def test_pivots_small_cases(spark):
    assert pivots.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
    got = pivots.near_duplicates(spark.createDataFrame([(5, [1.0, 0.0]), (3, [2.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0])], VEC)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(5, 1, 3, False), (3, 1, 3, True), (7, 0, 7, True), (None, 0, None, True)}


PAGE = "page_id long, url string, html string"


def site(i):
    body = f"<div class='x{'' if i % 2 else ' y'}'>"
    return f"<html><head><title>t</title></head><body><nav>Home {i}</nav><div class=box>Follow our site for more</div><article><h1>T &amp; {i}</h1><p>Para {i} one\n two<br>three<p>Second {i}<div class='tools'>Print this page</div><div class=comments><p>reader {i}</div></article><div class=ad>buy {i}</div>{body}</div><script>var a='</p>'</script><footer>&copy; {i}</footer></body></html>"


def test_site_tree(spark):
    rows = [(i, f"http://www.e.com/{i}", site(i)) for i in range(30)] + [(90, "http://o.com", "<p>a &lt; b</p>plain"), (91, None, None), (92, "http://o.com", "")]
    df = spark.createDataFrame(rows, PAGE)
    want = {i: f"T & {i}\nPara {i} one two three\nSecond {i}" for i in range(30)} | {90: "a < b\nplain", 91: "", 92: ""}
    for shipped in (1000, 0):
        got = {r["page_id"]: r for r in sitetree.extract(df, shipped=shipped).collect()}
        assert {k: r["text"] for k, r in got.items()} == want
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert sitetree.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_site_tree_without_article(spark):
    rows = [(i, "http://e.com/", f"<body><div class=hd>Same head</div><div class=main><p>Text {i}</p></div></body>") for i in range(12)]
    got = {r["text"] for r in sitetree.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {f"Text {i}" for i in range(12)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_site_tree_on_tables(spark):
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in sitetree.extract(pages).collect()}
    for r in pages.collect():
        a = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1|article)>", "\n", a)).split("\n"))
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scan", "mixing", "packing"] and P.ORACLE_SQL is None
    now = docs
    for name, stage in P.STAGES[:-1]:
        before, now = now, stage(spark, now, SF)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        ids = {r["doc_id"] for r in now.collect()}
        assert ids <= {r["doc_id"] for r in before.collect()}
        if name == "simhash_near_dedup":
            first = simhash.near_duplicates(before).where("doc_id = component_id").count()
            assert now.count() == first == len(ids)
        if name == "secret_scan":
            assert now.count() == before.count() and not now.where("text rlike 'token = \"[0-9a-f]{40}'").count()
    pieces = P.run(spark, SF)
    assert pieces.count() > 0 and {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids


@pytest.mark.parametrize("dim", [32, 64, 256])
def test_pivots_find_pairs_just_above_the_threshold(spark, dim):
    r = np.random.default_rng(dim)
    n = 1500
    a = r.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = r.standard_normal((n, dim))
    g -= (g * a).sum(1, keepdims=True) * a
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    c = r.uniform(0.9001, 0.92, (n, 1))
    x = np.vstack([a, c * a + np.sqrt(1 - c * c) * g])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    true = links_of(x)[0]
    found = got.loc[range(len(x)), "n_links"].to_numpy()
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()


def test_pivots_tie_rows_of_one_vec_id(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 1.0])]
    got = pivots.near_duplicates(spark.createDataFrame(rows, VEC).withColumn("root", F.lit(0)).withColumn("v", F.lit("x"))).collect()
    assert sorted((r["vec_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 4)]


def test_pivots_grow_with_the_table():
    m = [pivots.pivots_for(n) for n in (0, 100, 10_000, 1_000_000, 10**8, 10**12)]
    assert m == sorted(m) and m[0] == pivots.LEAST_PIVOTS and m[-1] == pivots.MOST_PIVOTS
    p = pivots.choose_pivots(np.vstack([np.eye(4)] * 3), 6, seed=1)
    assert p.shape == (6, 4) and (p[:4] == np.eye(4)).all()


def recall(x, got, k, queries):
    e, hit = x.astype(np.float64), 0
    for q in queries:
        s = e @ e[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:k]) & set(got[got.query_id == q].vec_id))
    return hit / (k * len(queries))


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_forest_recall_over_several_shards(spark, kind):
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 64))
    if kind == "clustered":
        x = x[r.integers(0, 60, 3000)] + 0.3 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    v = forest.usable(spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(x)], VEC))
    got = forest.search(v, v.where("id % 30 = 0"), 20, shard_rows=800, block_rows=40).toPandas()
    assert recall(x, got, 20, range(0, 3000, 30)) >= 0.9


def test_forest_ascends_only_as_far_as_the_neighbours_ask():
    r = np.random.default_rng(1)
    x = np.repeat(r.standard_normal((100, 32)), 60, axis=0) + 0.05 * r.standard_normal((6000, 32))
    f = forest.Forest(x)
    h = forest.hashes(np.column_stack([x[:50], np.zeros(50)]), forest.TREES, forest.SEED)
    depth = f.ascend(h, 400)
    assert max(len(c) for d in np.unique(depth) for c in f.within(h[:, depth == d], int(d))) < len(x) / 5
    for i, d in enumerate(depth.tolist()):  # against a plain comparison of prefixes
        same = ((f.sorted >> np.uint64(64 - d)) == (h[:, i : i + 1] >> np.uint64(64 - d))).sum() if d else f.sorted.size
        assert same >= 400
    assert forest.depth_for(1.0, 48) == 64 and forest.depth_for(-1.0, 48) == 0 and forest.depth_for(0.4, 48) < forest.depth_for(0.9, 48)


def test_forest_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 2.0])]
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "1 AS id", "'x' AS v", "2 AS shard", "3 AS block")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in forest.nearest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 0.5), (0, 3, 2, 0.0)]


def plain_poisson(mean, *parts):
    """Copies by inverting the Poisson distribution at a hashed number, one term after the other."""
    import hashlib
    import math

    u = int(hashlib.md5("|".join(parts).encode()).hexdigest()[:12], 16) / 2**48
    k, p = 0, math.exp(-mean)
    c = p
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_pipeline_against_plain_stages(spark, tmp_path):
    """run() on a small table with nulls, empty and repeated texts, clashing columns: every stage done again without Spark."""
    import collections
    import itertools

    import corpus_pipeline as P
    from corvane.llm import mixing, packing, secrets, tokens, toxicity

    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(r.choice(words, int(r.integers(30, 80))))
        if i % 4 == 0:
            w[3], w[9] = "nastyish", "vilestem"
        rows.append((i, " ".join(w), "en", f"src{i % 7}", i))
    rows += [(200, rows[1][1], "en", "src1", 0), (1, rows[2][1], "fr", "src2", 0), (201, None, None, None, None), (202, "", "en", "src3", 0), (203, rows[5][1] + ' token = "' + "ab12" * 10 + '"', "en", "src9", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_key string, fp int"
    spark.createDataFrame([(*x, "clash", 3) for x in rows], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, labels = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))

    field = toxicity.learn(docs, labels)
    kept = [x for x in rows if field.score(x[1]) < 0.5]
    assert 85 <= len(kept) <= 100
    fps = [simhash.fingerprint((x[1] or "").encode()) % 2**64 for x in kept]
    root = list(range(len(kept)))
    for _ in kept:
        for a, b in itertools.combinations(range(len(kept)), 2):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    groups = collections.defaultdict(list)
    for x, g in zip(kept, root, strict=True):
        groups[g].append(x)
    first = [min(g, key=lambda x: x[0]) for g in groups.values()]
    assert len(first) < len(kept) - 2 and len({x[0] for x in first if x[0] == 1}) == 1
    model = secrets.learn(spark.createDataFrame(first, "doc_id long, text string, lang string, source string, n_chars long"))
    clean = [(x[0], secrets.redact(x[1], model), x[3]) for x in first]
    chars = collections.Counter()
    for _, t, s in clean:
        chars[s or ""] += len(t or "")
    weight = {s: mixing.TARGET.get(s, 1.0) for s, n in chars.items() if n}
    total = sum(chars.values())
    rate = {s: total * weight[s] / sum(weight.values()) / n if n else 1.0 for s, n in chars.items()}
    copies = collections.Counter()
    for i, t, s in clean:
        copies[i, t or ""] += plain_poisson(rate[s or ""], mixing.SEED, str(i))
    enc, want = tokens.encoder("byte_bpe_50k"), collections.Counter()
    for (i, t), n in copies.items():
        want[i, len(enc.ids(t)) + 1] += n
    pieces = P.run(spark, str(tmp_path)).collect()
    got = collections.Counter()
    for p in pieces:
        got[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert got == collections.Counter({k: k[1] * n for k, n in want.items() if n})
    assert max(collections.Counter((p["sequence_id"], p["offset"]) for p in pieces).values()) == 1 and all(p["offset"] + p["length"] <= packing.WINDOW for p in pieces)
