import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing, packing, secrets, surrogates, tokens, toxicity

DOCS = "doc_id long, text string, source string"
HARD = ["", None, "a<|endoftext|>b  <|endoftext|>", "  \n\n x  y\t\tz ", "naïve é 中文 ½ Ⅷ ² ̃x", "it's they'll ''s 'S", "😀👋🏽 a​b", "x" * 3000, "_ __ a_b", "ſK 'ſ", "<|endof", " " * 3000 + "a"]


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source) for i, t in enumerate(texts)], DOCS)


def test_token_counts_and_ids_equal_the_library(spark):
    lib = tokens._library("byte_bpe_50k")
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in HARD]
    got = {r["doc_id"]: r for r in tokens.count_tokens(frame(spark, HARD).withColumn("n_tokens", F.lit(0))).collect()}
    assert [got[i]["n_tokens"] for i in range(len(HARD))] == [len(w) for w in want]
    assert [got[i]["n_bytes"] for i in range(len(HARD))] == [len((t or "").encode()) for t in HARD]
    assert [got[i]["over_limit"] for i in range(len(HARD))] == [len(w) > 1024 for w in want]
    assert [tokens.encoder("byte_bpe_50k").ids(t or "") for t in HARD] == want
    w = tokens.whole_tokens(tokens.vocabulary_path("byte_bpe_50k.json"))
    assert all(len(lib.encode(s, add_special_tokens=False).ids) == 1 for s in list(w.whole)[::97])
    assert tokens.count_tokens(frame(spark, [])).count() == 0


def test_packing_round_trip(spark):
    r = np.random.default_rng(2)
    texts = HARD + [" ".join(r.choice(["alpha", "beta.", "gamma", "delta\n"], int(n))) for n in r.integers(1, 4000, 40)]
    rows = packing.pack(frame(spark, texts).repartition(2)).collect()
    enc, by, seq = tokens.encoder("byte_bpe_50k"), collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        by[x["doc_id"]].append(x)
        seq[x["sequence_id"]].append(x)
    for i, t in enumerate(texts):
        ids, at = np.array([*enc.ids(t or ""), 1], "<u4"), 0
        for x in sorted(by[i], key=lambda x: x["start"]):
            assert (x["start"], x["doc_tokens"]) == (at, len(ids))
            assert x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids)
    padding = total = 0
    for pieces in seq.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= packing.WINDOW
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding < 0.02 * total
    assert packing.pack(frame(spark, [])).count() == 0


def test_cuts_are_optimal():
    r = np.random.default_rng(5)
    for _ in range(30):
        at = np.unique(np.concatenate([[0, 60], r.integers(1, 60, 25), np.arange(0, 60, 7)]))
        pen = np.concatenate([[0.0], r.integers(0, 9, len(at) - 1).astype(float)])
        cost = lambda ends: sum(20 - (b - a) + pen[list(at).index(b)] for a, b in zip([0, *ends], ends, strict=False))  # noqa: E731, B023
        best = {0: 0.0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + 20 - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= 20)
        ends = packing.best_cuts(at, pen, 20)
        assert all(b - a <= 20 for a, b in zip([0, *ends], ends, strict=False)) and abs(cost(ends) - best[len(at) - 1]) < 1e-9
    assert packing.tail_cuts(1536) == [1024, 1536] and packing.tail_cuts(2047) == [2047] and packing.tail_cuts(0) == []


def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?a)(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark):
    r = np.random.default_rng(0)
    rand = "".join(r.choice(list("ABCDEFGHJKLMNPQRSTabcdefghijkmnopqrst0123456789"), 36))
    texts = ["", None, 'é token = "' + "ab12" * 10 + '" x', "token: token: abcdefgh", "AKIA" + "Z9" * 10 + " AKIAAKIA", f"see {rand} here", "PASSWD='hunter22' secret=abc", "plain words, nothing else. " * 300, "customer_order_line_item_count_2024 2024-01-12T10-22-33_backup_file_final"]
    got = {x["doc_id"]: x for x in secrets.find_secrets(frame(spark, texts).withColumn("spans", F.lit("x"))).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(b[1] == k for b in base) for k in range(3)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    assert got[5]["spans"] == f"markov:4:{4 + len(rand)}" and not got[7]["spans"] and not got[8]["spans"]
    clean = secrets.redact_secrets(frame(spark, texts).withColumn("n_chars", F.lit(0).cast("long"))).orderBy("doc_id").collect()
    assert clean[5]["text"] == "see [SECRET] here" and clean[1]["text"] is None and clean[7]["text"] == texts[7] and clean[5]["n_chars"] == 17


def test_markov_models_separate_held_out_samples():
    model = secrets.train(secrets.labelled_samples(seed=1))
    held = secrets.labelled_samples(seed=2)
    right = [(secrets.ratio(s, model) > secrets.THRESHOLD) == bool(y) for s, y in held]
    assert np.mean(right) > 0.99


def corpus(n=600, seed=3):
    r = np.random.default_rng(seed)
    plain, bad = [f"word{i}" for i in range(200)], ["vilestem", "nastyish", "grossling"]
    rows = []
    for i in range(n):
        w = list(r.choice(plain, 60))
        y = int(i % 5 == 0)
        for _ in range(3 * y):
            w[int(r.integers(60))] = str(r.choice(bad)) + str(r.choice(["", "a", "en"]))
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(9990, None, "s"), (9991, "", "s")], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    field = toxicity.learn(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.score(docs, field).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert 0 <= got[9990]["score"] < 0.5 and got[9991]["score"] == got[9990]["score"]
    a, b, q = field.spans("Some VILESTEM here")[0]
    assert (a, b) == (5, 13) and q > 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 for x in got.values() if not x["predicted"])
    none = toxicity.learn(docs, labels.where("toxic = 0"))
    assert none is None and {x["score"] for x in toxicity.score(docs, none).collect()} == {0.0}


def test_marginals_equal_enumeration():
    f = toxicity.Field({"=bad": 3.0, "=odd": 1.2}, np.log([[0.9, 0.1], [0.4, 0.6]]), np.log([0.8, 0.2]), -1.5)
    words = "a bad b c odd bad d".split()
    at, s, n = f.read(" ".join(words))
    got, _ = f.marginals(at, s, n)
    emit = [f.plain + (f.emission(w) or 0.0) for w in words]
    total, on = 0.0, np.zeros(n)
    for k in range(2**n):
        y = [k >> i & 1 for i in range(n)]
        p = np.exp(f.start[y[0]] + sum(f.transition[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(e for e, v in zip(emit, y, strict=True) if v))
        total += p
        on += p * np.array(y)
    assert np.allclose(got, (on / total)[at])


def test_mixing_follows_targets(spark):
    rows = [(i, "x" * (50 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(6000)] + [(None, None, None), (1, "dup", "big")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mix_copy", F.lit("clash"))
    out = mixing.mix(docs, {"big": 1.0}, other=2.0).persist()
    assert out.columns == ["doc_id", "text", "source", "mix_rate", "mix_copy", "mix_key"]
    share = out.where("source = 'big'").agg(F.sum(F.length("text"))).first()[0] / out.agg(F.sum(F.length("text"))).first()[0]
    assert abs(share - 1 / (1 + 2 * 5)) < 0.02
    again = mixing.mix(docs.repartition(7), {"big": 1.0}, other=2.0)
    assert sorted(r["mix_key"] for r in out.collect()) == sorted(r["mix_key"] for r in again.collect())
    assert mixing.mix(spark.createDataFrame([], DOCS), {}).count() == 0


def test_poisson_inverse(spark):
    import math

    u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    for mean in (0.2, 1.0, 7.5):
        k = [r[0] for r in u.select(mixing.poisson_inverse(F.col("u"), F.lit(mean))).collect()]
        c, p, want = 0.0, math.exp(-mean), []
        cdf = []
        for i in range(80):
            c += p
            cdf.append(c)
            p *= mean / (i + 1)
        want = [next(j for j, v in enumerate(cdf) if v > (i + 0.5) / 2000) for i in range(2000)]
        assert k == want


def test_mixing_has_no_largest_rate(spark):
    rows = [(i, "x" * 1000, "big") for i in range(500)] + [(500, "rare words", "tiny")]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), {}).where("source = 'tiny'").select("mix_copy", "mix_rate", "mix_key").collect()
    assert out[0]["mix_rate"] == 25000.5 and abs(len(out) / 25000.5 - 1) < 0.02
    assert sorted(r["mix_copy"] for r in out) == list(range(1, len(out) + 1)) and len({r["mix_key"] for r in out}) == len(out)
    n = [r["n"] for r in spark.range(2000).select(mixing.poisson(F.lit(1234.0), F.lit("s"), F.col("id").cast("string")).alias("n")).collect()]
    assert abs(np.mean(n) - 1234) < 4 and abs(np.var(n) / 1234 - 1) < 0.15


def test_surrogates(spark):
    texts = [
        "Mail Foo.Bar92@mail2.example.com or foo.bar92@MAIL2.example.com, call +1 (830) 555-5433 or 830-555-5433, ip 154.127.37.204 ok.",
        "Card 4111111111111111 4111-1111-1111-1111 ssn 123-45-6789. Mr. John Smith met Mrs Smith and María García; Господин Иван Петров.",
        None, "", "nothing at 3.5 or 12.04.2020", "x" * 50_000 + " a@b.co",
    ]
    out = surrogates.replace_pii(frame(spark, texts).withColumn("n_email", F.lit("clash"))).orderBy("doc_id").collect()
    t0, t1 = out[0]["text"], out[1]["text"]
    mails = re.findall(r"\S+@\S+\.com", t0)
    assert mails[0].lower() == mails[1].lower() != "foo.bar92@mail2.example.com" and mails[0][0].isupper()
    phones = re.findall(r"\(?(\d{3})\)?[ -](\d{3})-(\d{4})", t0)
    assert phones[0] == phones[1] != ("830", "555", "5433") and "+1 (" in t0
    assert all(0 <= int(x) <= 255 for x in re.search(r"ip (\S+) ok", t0)[1].split("."))
    cards = re.findall(r"\d[\d-]{15,18}", t1)
    digits = cards[0]
    assert digits == cards[1].replace("-", "") and digits[0] == "4" and luhn(digits)
    first = re.search(r"Mr\. (\S+) (\S+) met Mrs (\S+) and (\S+) ", t1)
    assert first[2] == first[3] != "Smith" and first[1] in surrogates.FIRST_NAMES["male"] and first[4] in surrogates.FIRST_NAMES["female"]
    assert re.search(r"Господин (\S+) ", t1)[1] in surrogates.FIRST_NAMES["cyrillic_male"]
    assert (out[2]["text"], out[3]["text"], out[4]["text"], out[2]["n_entities"]) == (None, "", texts[4], 0)
    assert out[5]["n_email"] == 1 and out[5]["text"].startswith("x" * 50_000)
    assert surrogates.replace_pii(frame(spark, [])).count() == 0


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_surrogates_stay_distinct(spark):
    many = [f"u{i}@mail.example.com 10.0.{i % 200}.{i % 256} (2{i % 90 + 10}) 555-{i:04} {4000000000000000 + i * 7919}" for i in range(400)]
    assert surrogates.collisions(frame(spark, many)).count() == 0
    got = surrogates.replace_pii(frame(spark, many)).select("text").collect()
    assert len({r["text"].split()[0] for r in got}) == 400


@pytest.mark.parametrize("key", ["a", "b"])
def test_surrogates_are_keyed(spark, key):
    one = surrogates.replace_pii(frame(spark, ["a@bcd.com"]), key).first()["text"]
    assert one != surrogates.replace_pii(frame(spark, ["a@bcd.com"]), key + "x").first()["text"]


def test_markov_models_pass_identifiers_of_unlisted_words():
    words = "rocket rotate scanner segment shader signal snapshot sprite strategy subtitle texture thumbnail tooltip tunnel umbrella upstream vertex viewport wildcard workflow yesterday zebra zenith".split()
    assert not set(words) & set(secrets.WORDS) and {w[0] for w in secrets.WORDS} >= set("abcdefghijklmnopqrstuvwxyz") - set("xyz")
    r, wrong, n, model = random.Random(3), 0, 0, secrets.default_model()
    for i in range(3000):
        parts = [r.choice(words) for _ in range(r.randint(3, 6))]
        parts.insert(r.randint(1, len(parts)), str(r.randint(0, 9999)))
        s = ["_".join(parts), "-".join(parts), "".join(p.capitalize() for p in parts), "_".join(parts).upper(), "".join(parts)][i % 5]
        n, wrong = n + 1, wrong + (secrets.ratio(s, model) > secrets.THRESHOLD)
    assert wrong <= n // 100
    for s in ("TestTotalSystemSearchWindowTest49", "RecordSessionTimeRegion24RequestThread"):
        assert secrets.scan(f"see {s} here")[1] == [] and secrets.redact(f"see {s} here") == f"see {s} here"


def test_surrogates_take_whole_names_and_later_mentions(spark):
    texts = ["Mary Jane Smith came.", "Mary Smith-Jones came.", "James T. Kirk came; Kirk left, Kirkland stayed.", "Juan Vega Robles came.", "Jean-Pierre Dupont came.", "Ask Mary Smith. Later Smith and the Smiths met.", "Dr. James T. Kirk came."]
    out = [r["text"] for r in surrogates.replace_pii(frame(spark, texts)).orderBy("doc_id").collect()]
    for t, left in zip(out, ("Mary Jane Smith", "Mary Smith Jones", "James T. Kirk", "Juan Vega Robles", "Jean Pierre Dupont", "Mary Smith", "James T. Kirk"), strict=True):
        assert not [w for w in left.split() if re.search(rf"(?<!\w){re.escape(w)}(?!\w)", t)], t
    kirk = re.fullmatch(r"\w+ \w\. (\w+) came; (\w+) left, Kirkland stayed\.", out[2])
    smith = re.fullmatch(r"Ask \w+ (\w+)\. Later (\w+) and the Smiths met\.", out[5])
    assert kirk[1] == kirk[2] and smith[1] == smith[2] and f" {smith[1]} came" in out[0]


def test_mixing_sql_has_no_largest_rate(spark, tmp_path):
    import duckdb

    rows = [(i, "x" * 600, "en", "src9", 600) for i in range(20)] + [(20, "rare", "en", "src1", 4), (21, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(tuple(r) for r in mixing.mix(docs, mixing.TARGET).where("source = 'src1'").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = sorted(con.execute(f"SELECT * FROM ({mixing.ORACLE}) WHERE source = 'src1'").fetchall())
    assert got == want and got[0][5] > 1500


def test_mixing_stage_keeps_clashing_columns(spark):
    import corpus_pipeline as P

    docs = frame(spark, ["a b c", None, ""]).withColumn("mix_source", F.lit(1)).withColumn("mix_key", F.lit("k")).withColumn("doc", F.lit(2)).withColumn("mix_copies", F.lit(9))
    out = P.mixing_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {(r["mix_source"], r["mix_key"], r["doc"], r["mix_copies"]) for r in out.collect()} <= {(1, "k", 2, 9)}


def test_the_fields_gradient_is_exact():
    r = np.random.default_rng(0)
    names = ["=bad", "=oddly", "=cc"]
    seqs = [list(r.choice(["bad", "oddly", "cc", "x", "y", "z"], int(n))) for n in r.integers(1, 12, 6)]
    data = toxicity.Sequences(seqs, [r.integers(0, 2, len(s)) for s in seqs], names)
    x = 0.7 * r.normal(size=len(names) + 7)
    _, g = data.likelihood(x, 0.1)
    step = lambda i: 1e-5 * np.eye(len(x))[i]
    numeric = [(data.likelihood(x + step(i), 0.1)[0] - data.likelihood(x - step(i), 0.1)[0]) / 2e-5 for i in range(len(x))]
    assert np.allclose(g, numeric, atol=1e-6)


def test_the_field_learns_its_chain():
    """Toxic words stand in runs; whether a doubtful word is toxic depends on the word before it."""
    r, seqs, tags = np.random.default_rng(2), [], []
    for _ in range(300):
        y = [int(v) for v in r.random(3) < 0.4]
        seqs.append([w for v in y for w in ["vile" if v else "plain", *["maybe"] * 5]])
        tags.append(np.repeat(y, 6))
    f = toxicity.fit_field(seqs, tags, ["=vile", "=maybe", "=plain"])
    toxic = lambda text: f.marginals(*f.read(text))[0][-1]
    assert toxic("vile maybe") > 0.8 > 0.2 > toxic("plain maybe")


def test_toxicity_edge_cases(spark):
    rows = corpus(200)
    docs = [(i, t, "s") for i, t, _ in rows] + [(0, "another text of the same id", "s")] * 3 + [(None, None, None), (9999, "vilestem " + "plain words " * 60_000, "s")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS score", "2 AS id", "'x' AS spans", "3 AS toxic")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    field = toxicity.learn(df, labels, sample=30)
    got = toxicity.score(df, field).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert by[9999]["spans"] == "0:8" and by[None]["spans"] == "" and not by[None]["held_out"]
    for i, t, _ in rows[:30]:
        assert by[i]["spans"] == ",".join(f"{a}:{b}" for a, b, _ in field.spans(t)) or i == 0
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns
    assert toxicity.score(spark.createDataFrame([], DOCS), field).count() == 0 and toxicity.learn(spark.createDataFrame([], DOCS), labels) is None


def test_secret_models_learn_from_the_documents(spark):
    r = np.random.default_rng(7)
    rand = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz": "".join(r.choice(list(a), n))
    texts = [f"ordinary words here token = \"{rand(30, '0123456789abcdef')}\" and more_ordinary_identifier_{i % 7} follow" for i in range(60)]
    key = rand(28)
    docs = frame(spark, [*texts, f"see {key} now", None, "", "same", "same"]).selectExpr("*", "1 AS value", "2 AS rank", "3 AS label")
    samples = secrets.corpus_samples(docs, 40)
    assert sum(y for _, y in samples) == 40 and 0 < sum(1 - y for _, y in samples) <= 40 and not any("token" in v for v, y in samples if y)
    got = {x["doc_id"]: x for x in secrets.find_secrets(docs).collect()}
    assert len(got) == 65 and got[60]["spans"] == f"markov:4:{4 + len(key)}"  # letters alone
    model = secrets.learn(docs)
    for i, t in enumerate(texts):  # brute force: every long run against the models
        base = brute_base(t)
        more = [(m.start(), 3, m.end()) for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t) if secrets.ratio(m[0], model) > secrets.THRESHOLD and not any(a <= m.start() and m.end() <= b for a, _, b in base)]
        assert got[i]["spans"] == secrets.joined(sorted(base + more))
    many = "token=" + " token=".join(rand(24) for _ in range(3000))
    assert secrets.scan(many, model)[1] == secrets.scan(many, model)[0] != []
    assert secrets.find_secrets(frame(spark, [])).count() == 0


def test_tokens_and_packing_take_endless_blanks_and_repeats(spark):
    texts = [" " * 1_000_000 + "a", "b", "b", None]
    lib = tokens._library("byte_bpe_50k")
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert tokens.encoder("byte_bpe_50k").ids(texts[0]) == want[0]
    docs = spark.createDataFrame([(7, t, "s") for t in texts], DOCS).selectExpr("*", "1 AS start", "2 AS length", "3 AS n_bytes", "4 AS offset")
    assert sorted(r["n_tokens"] for r in tokens.count_tokens(docs).collect()) == sorted(map(len, want))
    pieces = packing.pack(packing.in_ranges(docs)).collect()
    assert sum(r["length"] for r in pieces) == sum(len(w) + 1 for w in want) and {r["doc_id"] for r in pieces} == {7}


def test_surrogates_keep_country_codes_and_lengths(spark):
    texts = ["Call +49 30 123456 or +33 1 23 45 67 89 now.", "+44 (20) 7946 0958, +1 830 555 5433 and 830-555-5433", "2 +5 12 34 = 51", "at 1.2.3.4 and 250.250.250.250"]
    out = surrogates.replace_pii(frame(spark, texts).withColumn("n_chars", F.length("text"))).orderBy("doc_id").collect()
    german, french = re.search(r"Call (\+49 \d\d \d{6}) or (\+33 \d \d\d \d\d \d\d \d\d) now", out[0]["text"]).groups()
    assert german != "+49 30 123456" and french != "+33 1 23 45 67 89" and out[0]["n_phone"] == 2
    british, national = re.match(r"(\+44 \(\d\d\) \d{4} \d{4}), \+1 (\d{3} \d{3} \d{4}) and", out[1]["text"]).groups()
    assert british != "+44 (20) 7946 0958" and national.replace(" ", "-") == out[1]["text"][-12:]
    assert out[2]["text"] == texts[2] and out[2]["n_entities"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in out)


# A plain twin of the surrogate cipher, written from its description: one character after the other, in Python.
def plain_cipher(s, key, label, first=None):
    def step(lab, before):
        return int(hashlib.md5(f"{key}|{lab}|{before}".encode()).hexdigest()[:8], 16)

    def move(c, n, classes):
        for k in classes:
            if c in k:
                return k[(k.index(c) + n) % len(k)]
        return c

    def run(t, lab, head=None):
        return "".join(move(c, step(lab, t[:i]), head if head and i == 0 else surrogates.CLASSES) for i, c in enumerate(t))

    forward = run(s, label + ">", first)
    if first:
        return forward[:1] + run(forward[1:][::-1], label + "<")[::-1]
    return run(forward[::-1], label + "<")[::-1]


def plain_case(model, s):
    return "".join(o.upper() if m != m.lower() and len(o.upper()) == 1 else o for m, o in zip(model, s, strict=True))


def plain_digits(model, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in model)


def plain_check_digit(body):
    d = [int(c) for c in body[::-1]]
    return -sum(sum(divmod(2 * x, 10)) for x in d[::2]) % 10 - sum(d[1::2]) % 10


def plain_word(w, key):
    moved, low = surrogates.moved_first_names(key), w.lower()
    if low.rstrip(".") in {t.lower() for t in surrogates.TITLES}:
        return w
    if low in moved:
        return moved[low].upper() if w == w.upper() else moved[low]
    z = plain_cipher(low, key, "name")
    while z in moved:
        z = plain_cipher(z, key, "name")
    return plain_case(w, z)


def plain_surrogate(kind, m, key):
    d = re.sub(r"\D", "", m)
    if kind == "email":
        body, top = re.fullmatch(r"(.*)(\.[A-Za-z]+)", m).groups()
        return plain_case(body, plain_cipher(body.lower(), key, "email")) + top
    if kind == "ip":
        def run(octets, label):
            out = []
            for i, n in enumerate(octets):
                before = "".join(f".{x}" for x in octets[:i])
                out.append((n + int(hashlib.md5(f"{key}|{label}|{before}".encode()).hexdigest()[:8], 16)) % 256)
            return out

        return ".".join(map(str, run(run([int(x) for x in m.split(".")], "ip>")[::-1], "ip<")[::-1]))
    if kind == "ssn":
        return plain_digits(m, plain_cipher(d, key, "ssn"))
    if kind == "card":
        body = d[0] + plain_cipher(d[1:-1], key, "card")
        last = (plain_check_digit(body) + int(d[-1]) - plain_check_digit(d[:-1])) % 10
        return plain_digits(m, body + str(last))
    if kind == "phone":
        code = ""
        if m.startswith("+"):
            code = next((d[:n] for n in (1, 2) if d[:n] in surrogates.CODES), d[:3])
        return plain_digits(m, code + plain_cipher(d[len(code) :], key, "phone", ("23456789", "01")))
    return "".join(x if x in " -" else plain_word(x, key) for x in re.split(r"([ -])", m))


def test_surrogates_against_a_plain_twin(spark):
    import regex

    key = "k9"
    kinds = {k: regex.compile(p.replace(r"++@", "+@")) for k, p in surrogates.PATTERNS.items()}
    texts = [
        "Write to Ann.Lee+x@mail.example.org, ip 10.0.200.7; card 5500 0000 0000 0004; ssn 078-05-1120.", "Call +44 20 7946 0958 or (830) 555-5433 or +351 21 123 4567!",
        "Dr. Élodie Marchand-Lévy met MARIE Curie, Анна Петрова and Juan Vega.", "José García Ruiz, josé@x.io", "no one here", "Mr Smith 4012888888881881 and 4012888888881881",
    ]
    any_ = regex.compile("|".join(f"(?:{p})" for p in surrogates.PATTERNS.values()).replace(r"++@", "+@"))
    out = [r["text"] for r in surrogates.replace_pii(frame(spark, texts), key).orderBy("doc_id").collect()]
    for t, got in zip(texts, out, strict=True):
        want, at = [], 0
        found = list(any_.finditer(t))
        for m in found:
            kind = next(k for k, p in kinds.items() if p.fullmatch(t, m.start(), m.end()) or p.fullmatch(m[0]))
            want += [t[at : m.start()], plain_surrogate(kind, m[0], key)]
            at = m.end()
        assert got == "".join(want) + t[at:], t
    assert sum(a != b for a, b in zip(texts, out, strict=True)) == 5


def test_surrogates_of_texts_that_hold_the_marks(spark):
    t = "Mail a.b@c.org, card 4111111111111111 and Mr. John Smith; Smith left. 2.3.4.5"
    marked = [t, f"{surrogates.MARK} {t}", f"{t}{surrogates.GROUP}", surrogates.MARK, f"x{surrogates.GROUP}{surrogates.MARK}"]
    out = surrogates.replace_pii(frame(spark, marked)).orderBy("doc_id").collect()
    assert out[1]["text"] == f"{surrogates.MARK} {out[0]['text']}" and out[2]["text"] == f"{out[0]['text']}{surrogates.GROUP}"
    assert [r["text"] for r in out[3:]] == marked[3:] and [r["n_entities"] for r in out] == [4, 4, 4, 0, 0]
