import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from corvane.functions import png
from corvane.operators import designs, gates, ledger, lint, migrate, parity, reviews, similarity, structure, sweep, tokens, visual
from corvane.operators import measure as M


def test_copy_similarity(spark):
    original = "Plan your week in one calm calendar that shows what matters most to you today."
    texts = [(1, "Nothing alike stands in here at all, as it happens."), (2, "We sell pens. Plan your week in one calm calendar that shows what matters to us."), (3, "By continuing you agree to our terms of service and privacy policy")]
    hits = similarity.copy_hits(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(9, original), (8, texts[2][1])], "item_id long, text string")).collect()
    assert [(h["doc_id"], h["sent_pos"], h["original"], h["shared"]) for h in hits] == [(2, 1, original, 11)]


REVIEW = "id string, source string, url string, date string, rating string, text string, pos int"


def test_reviews(spark):
    rows = [("a1", "App", "http://s/1", "2026-09", "1", "Prices — doubled “overnight”", 0), ("a2", "web", "http://s/2", "2026-08-01", "2", "too slow", 1), ("", "App", "http://s/3", "2023-01-01", "", "no export", 2), ("a4", "App", "", "2026-01-01", "1", "x", 3), ("a5", "App", "http://s/5", "2026-01-01", "1", "uncited", 4)]
    r = spark.createDataFrame(rows, REVIEW)
    kept = reviews.usable(r)
    assert {x["id"] for x in kept.collect()} == {"a1", "a2", "row-4", "a5"}
    assert reviews.dropped(r).first()["dropped"] == 1
    ok = spark.createDataFrame([([("t", "hate", "T", "", ["a1", "a2", "row-4", "a1"], [("a1", "prices - DOUBLED \"overnight\"")])],)], reviews.ANALYSIS).select(F.explode("themes").alias("t")).select("t.*")
    s = reviews.theme_summary(kept, ok, dt.date(2026, 10, 1)).first()
    assert (s["reviews"], s["sources"], s["weight"], s["thin"]) == (3, ["app", "web"], 2.1, False)
    assert reviews.errors(kept, ok).count() == 0
    assert [x["id"] for x in reviews.first_uncovered(kept, ok).collect()] == ["a5"]
    assert reviews.coverage(kept, ok).first()["coverage"] == 67
    bad = spark.createDataFrame([([("t", "hate", None, "", ["a1", "zz"], [("a1", "invented")])],)], reviews.ANALYSIS).select(F.explode("themes").alias("t")).select("t.*")
    assert sorted(x["rule"] for x in reviews.errors(kept, bad).collect()) == ["not-word-for-word", "unknown-row"]
    assert reviews.theme_summary(kept, bad, dt.date(2026, 10, 1)).first()["thin"]
    assert str(spark.range(1).select(reviews.months_back(F.lit(dt.date(2026, 8, 31)), 18)).first()[0]) == "2025-03-03"


FEATURE = "id string, feature string, area string, priority string, original string, clone string, source string, notes string, __line int"


def test_parity(spark):
    base = [("1", "a", "x", "must", "yes", "yes", "s", "", 2), ("2", "b", "", "must", "yes", "yes", "s", "", 3), ("3", "c", "x", "could", "yes", "skip", "s", "why", 4)]
    frame = lambda rows: spark.createDataFrame(rows, FEATURE)
    say = lambda rows, beat=None: parity.verdict(frame(rows), beat).first()
    assert say(base)["verdict"] == "shippable"
    assert say([base[0], (*base[1][:5], "no", *base[1][6:])])["verdict"] == "not shippable"
    fixes = [(str(i), "f", "x", "should", "no", "yes", "s", "", i) for i in (5, 6, 7)]
    beat = lambda *m: spark.createDataFrame(list(m), "name string, original double, clone double, better string")
    got = say(base + fixes, beat(("clicks", 6.0, 3.0, "lower")))
    assert got["verdict"] == "better than the original" and got["why"] == "3 fix(es) built, 1 measured win(s), no losses"
    assert say(base + fixes, beat(("clicks", 6.0, 3.0, "lower"), ("lcp", 900.0, 2000.0, "lower")))["verdict"] == "shippable"
    assert say([])["verdict"] == "not shippable"
    p = parity.problems(frame([("3", "c", "x", "could", "yes", "skip", "s", "", 4)])).collect()
    assert [(x["line"], x["problem"]) for x in p] == [(4, "skip-reason")]


ITEM = "source_id string, pos long, kind string, t string"


def test_copy_lint(spark):
    items = [("heading", "Unlock seamless growth!"), ("text", "Trusted by 10,000 teams"), ("button", "Submit"), ("text", "lorem ipsum dolor"), ("text", "Oops, it broke"), ("text", "A robust tool. Very robust."), ("text", "It is robust — really"), ("heading", "Go 🚀"), ("text", "Better than Calendly")]
    f = lint.check_copy(spark.createDataFrame([("p", i, k, t) for i, (k, t) in enumerate(items)], ITEM), avoid=["Calendly"]).collect()
    rules = {x["rule"] for x in f}
    assert {"word:unlock", "word:seamless", "exclamation", "proof:user-count", "proof:trusted-by", "generic-button", "placeholder", "vague-error", "word:robust", "em-dash", "emoji", "their-name"} <= rules
    assert next(x for x in f if x["rule"] == "word:robust")["level"] == "warning"
    backed = lint.check_copy(spark.createDataFrame([("p", 0, "text", "Trusted by 10,000 teams")], ITEM), claims=["Trusted by 10,000 teams"])
    assert not [x for x in backed.collect() if x["level"] == "error"]
    md = lint.items_of_markdown(spark.createDataFrame([("d", "# Title\n\n- see [docs](http://x)\n```\n<!-- c -->\n`code` only")], "doc_id string, text string")).orderBy("pos").collect()
    assert [(x["kind"], x["t"]) for x in md] == [("heading", "Title"), ("text", "see docs"), ("text", "`"), ("text", "only")]
    cta = spark.createDataFrame([("p", i, "button", "Start now") for i in range(3)], ITEM)
    assert lint.repeated_cta(lint.prepared(cta)).count() == 1


def test_listing(spark):
    rows = [("l", "appStore", "name", "Calm 🚀 planner for all the people in it"), ("l", "appStore", "subtitle", "The BEST plan"), ("l", "appStore", "keywords", "plan, calm,week,week"), ("l", "appStore", "description", ""), ("l", "googlePlay", "title", "Calendly plan")]
    f = lint.lint_listing(spark.createDataFrame(rows, "listing_id string, store string, field string, value string"), ["Calendly"]).collect()
    text = " ".join(x["message"] for x in f)
    for part in ("No emoji", "the limit is 30", "Ranking", "Spaces after commas", "Already in the name or subtitle: plan, calm", "Repeated: week", "Empty.", "calendly"):
        assert part in text, part


DESIGN = "design_id string, name string, colors map<string,string>, dark map<string,string>, typography map<string,struct<fontFamily:string,fontSize:string>>, rounded map<string,string>, spacing map<string,string>, components map<string,map<string,string>>, pairs array<array<string>>"


def test_design_lint(spark):
    good = ("g", "Calm", {"canvas": "#ffffff", "ink": "#16181d", "accent": "#0a6b4f", "surface": "#f4f4f1", "ink-soft": "#555b66", "on-accent": "#ffffff", "border": "#cccccc"}, None, {"small": ("A", "13px"), "body": ("A", "16px"), "h": ("B", "24px"), "display": ("B", "40px")}, {"sm": "4px"}, {"a": "8px", "b": "16px"}, {"button": {"bg": "{colors.accent}"}}, None)
    bad = ("b", "", {"canvas": "#ffffff", "ink": "#000000", "accent": "#7c3aed", "ink-soft": "#bbbbbb", "x": "nope"}, None, {"body": ("Inter", "12px")}, {}, {"a": "7px"}, {"button": {"bg": "{colors.gone}"}}, None)
    theirs = sweep.colors(spark.createDataFrame([("#7a3bec",)], "color string"))
    fonts = spark.createDataFrame([("Circular", 10)], "family string, chars int")
    f = designs.lint(spark.createDataFrame([good, bad], DESIGN), theirs, fonts).collect()
    assert not [x for x in f if x["design_id"] == "g"], f
    assert {x["rule"] for x in f} >= {"roles", "invalid-color", "contrast", "too-close", "ai-violet", "pure-black", "type-scale", "fonts", "body-size", "spacing", "missing-token", "name"}


def test_spacing_and_clusters(spark):
    v = spark.createDataFrame([("a", x, 5) for x in (8, 16, 24, 32, 48)] + [("b", 6, 3), ("b", 10, 3)], "page string, value int, count int")
    assert {r["page"]: r["base"] for r in tokens.spacing_base(v, ["page"]).collect()} == {"a": 8, "b": 2}
    use = [("p", "#ffffff", h, t, b, 0, 0, a, 0) for h, t, b, a in (("#111111", 900, 0, 0), ("#121212", 50, 0, 0), ("#666666", 400, 0, 0), ("#0066ff", 5, 10, 9), ("#f5f5f0", 0, 800, 0), ("#ffffff", 0, 5000, 0))]
    u = spark.createDataFrame(use, "page string, canvas string, hex string, text long, bg long, border long, icon long, action long, label long")
    c = tokens.cluster_colors(tokens.color_usage(u, ["page"]), ["page"])
    assert {r["hex"]: r["text"] for r in c.collect()}["#111111"] == 950
    r = tokens.color_roles(c.withColumn("canvas", F.lit("#ffffff")), ["page"]).first()
    assert (r["ink"], r["ink_soft"], r["surface"], r["accent"], r["on_accent"], r["brand"]) == ("#111111", "#666666", "#f5f5f0", "#0066ff", "#ffffff", ["#0066ff"])


NODE = "pair_id string, side string, role string, x int, y int, w int, h int, name string, pos long"


def test_structure(spark):
    base = [("header", 0, 0, 1440, 80, ""), ("nav", 200, 20, 800, 40, ""), ("h1", 300, 200, 800, 60, "Hi"), ("button", 600, 500, 200, 48, "Go"), ("input", 1100, 30, 200, 30, ""), ("image", 100, 1200, 600, 400, ""), ("footer", 0, 2800, 1440, 200, "")]
    a = [("p", "a", r, x, y, w, h, n, i) for i, (r, x, y, w, h, n) in enumerate(base)]
    b = [("p", "b", r, x, y + (460 if r == "button" else 0), w, h, n, i) for i, (r, x, y, w, h, n) in enumerate(base) if r != "input"]
    pages = spark.createDataFrame([("p", s, 1440, 900, 3000) for s in "ab"], "pair_id string, side string, view_w int, view_h int, page_h int")
    same = spark.createDataFrame(a + [("p", "b", *x[2:]) for x in a], NODE)
    m = structure.match_nodes(same, pages)
    assert structure.structure_score(structure.by_role(same, m)).first()["score"] == 100 and structure.order_score(same).first()["order_score"] == 100
    other = spark.createDataFrame(a + b, NODE)
    m = structure.match_nodes(other, pages)
    lost = structure.unmatched(other, m, pages, "a").collect()
    assert [(x["role"], x["where"]) for x in lost] == [("input", "top bar, right")]
    assert [x["name"] for x in structure.moved_across_fold(other, m, pages).collect()] == ["Go"]
    s = np.random.default_rng(0).random((6, 5))
    pairs = structure.best_matching(s)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_nearest_brand_makes_no_pairs(spark):
    lab = "named_struct('l', {0}, 'a', 0d, 'b', 0d)"
    colors = spark.range(6).selectExpr("id div 2 AS color_id", f"CASE WHEN id <> 1 AND id < 4 THEN {lab.format('id / 10')} END AS lab")
    brand = spark.sql(f"SELECT color, {lab.format('l')} AS lab FROM VALUES ('b', 0.1d), ('a', 0.1d), ('c', 0.3d) t(color, l)")
    got = designs.nearest_brand(colors, brand)
    assert {r["color_id"]: (r["nearest"], r["distance"] if r["distance"] is None else round(r["distance"], 6)) for r in got.collect()} == {0: ("a", 10.0), 1: ("c", 0.0), 2: ("a", None)}
    assert designs.nearest_brand(colors, brand.limit(0)).count() == 0
    # aggregates sort what was dealt out, never a whole file's rows; the keys are dealt out once
    plan = designs.nearest_brand(spark.range(9).selectExpr("id color_id", f"{lab.format('id / 10')} lab").repartition("color_id"), brand)._jdf.queryExecution().sparkPlan().toString()
    assert "min_by" not in plan and "Generate" not in plan


def test_groups_are_matched_in_batches(spark):
    r = np.random.default_rng(3)
    rows = []
    for g in range(60):
        for side in "ab":
            for k in range(int(r.integers(0, 25))):
                rows.append((str(g // 3), side, f"h{g % 3 + 1}", int(r.integers(6)) * 90, int(r.integers(25)) * 40, int(r.integers(1, 4)) * 200, 40, [None, "", "N", "n", "o"][int(r.integers(5))], g * 100 + k))
    nodes = spark.createDataFrame(rows, NODE)
    size = {(str(p), s): (0 if p % 5 == 0 else 1000, 900, 1000 + p) for p in range(20) for s in "ab" if (p, s) != (7, "b")}
    pages = spark.createDataFrame([(*k, *v) for k, v in size.items()], "pair_id string, side string, view_w int, view_h int, page_h int")
    full = nodes.join(pages, ["pair_id", "side"]).toPandas()
    want = set()
    for (pair, role), both in full.groupby(["pair_id", "role"]):
        a, b = (both[both["side"] == s].sort_values(["y", "x", "pos"]) for s in "ab")
        if len(a) and len(b):
            want |= {(pair, role, int(a["pos"].iloc[i]), int(b["pos"].iloc[j])) for i, j in structure.best_matching(structure.similarities(a, b))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        m = structure.match_nodes(nodes, pages)
        assert {tuple(x) for x in m.collect()} == want and len(want) > 200
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # no call of Python for each group
    assert "FlatMapGroups" not in m._jdf.queryExecution().toString()
    assert structure.match_nodes(nodes.limit(0), pages).count() == 0


def test_lcs_length(spark):
    df = spark.createDataFrame([(list("abcab"), list("bcb")), ([], ["a"]), (["a"], ["b"]), (list("xyz"), list("xyz"))], "a array<string>, b array<string>")
    assert [x[0] for x in df.select(structure.lcs_length("a", "b")).collect()] == [3, 0, 0, 3]


def _page(height=600, shift=0, seed=1):
    r = np.random.default_rng(seed)
    img = np.full((height + shift, 720, 4), 255, np.uint8)
    for i in range(12):
        y = shift + 20 + i * 45
        img[y : y + 12, 40 : 40 + int(r.integers(200, 600)), :3] = 30
    return img


def test_png_and_visual(spark):
    small = np.random.default_rng(3).integers(0, 256, (4, 8, 4)).astype(np.uint8)
    assert (png.decode(png.encode(small)) == small).all()
    assert png.resize(_page(), 360).shape == (300, 360, 4)
    same = visual.compare(_page(), _page())
    assert same["score"] == 100 and not same["drift"]
    moved = visual.compare(_page(), _page(shift=80))
    assert moved["score"] >= 85 and max(d["shift"] for d in moved["drift"]) >= 60
    assert visual.compare(_page(), _page(seed=9), pixel=True)["score"] < 100
    rows = spark.createDataFrame([("p", bytearray(png.encode(_page())), bytearray(png.encode(_page())), None), ("q", bytearray(b"no"), bytearray(b"no"), None)], "pair_id string, a binary, b binary, masks string")
    got = {r["pair_id"]: r["score"] for r in visual.compare_pairs(rows).collect()}
    assert got == {"p": 100.0, "q": None}
    assert visual.parse_masks("1,2,3,4;x;5,6") == [(1.0, 2.0, 3.0, 4.0)]


def test_robots(spark):
    text = "# c\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nDisallow:\nSitemap: http://s/x.xml\n\nUser-agent: bot\nUser-agent: other\nDisallow: /only\n"
    p = migrate.robots_lines(spark.createDataFrame([("h", text)], "host string, text string"))
    paths = spark.createDataFrame([("h", x) for x in ("/a/x", "/a/b/c", "/f.pdf", "/f.pdf?x", "/z", "/robots.txt")], "host string, path string")
    ok = lambda agent: {r["path"]: r["allowed"] for r in migrate.allowed(paths, migrate.rules_for(p, agent)).collect()}
    assert ok("me") == {"/a/x": False, "/a/b/c": True, "/f.pdf": False, "/f.pdf?x": True, "/z": True, "/robots.txt": True}
    assert all(ok("Bot").values())
    assert migrate.robots_sitemaps(spark.createDataFrame([("h", text)], "host string, text string")).first()["sitemap"] == "http://s/x.xml"


def test_trace_and_sweep(spark):
    hops = spark.createDataFrame([("a", 301, "b"), ("b", 200, None), ("l", 302, "l")], "url string, status int, location string")
    got = {r["url"]: (r["final"], r["status"], r["hops"]) for r in migrate.trace(spark.createDataFrame([("a",), ("l",), ("n",)], "url string"), hops).collect()}
    assert got == {"a": ("b", 200, 1), "l": ("l", 310, 6), "n": ("n", 0, 0)}
    files = spark.createDataFrame([("src/a.tsx", "const CalendlyEmbed = 1\n// calendar\nbg: #006bfe // sweep-allow\nhttps://calendly.com/x")], "path string, content string")
    rows = sweep.lines(files)
    assert [r["line"] for r in sweep.name_hits(rows, sweep.names(spark.createDataFrame([("Calendly",)], "name string"))).orderBy("line").collect()] == [1, 4]
    assert sweep.domain_hits(rows, sweep.domains(spark.createDataFrame([("www.calendly.com",)], "domain string"))).count() == 1
    c = sweep.tag(sweep.color_hits(rows, sweep.colors(spark.createDataFrame([("#006bff",)], "color string")))).first()
    assert (c["line"], c["level"]) == (3, "allowed")
    d = "M" + " 10.04 20" * 12
    svg = spark.createDataFrame([("i.svg", f'<path d="{d}"/>')], "path string, content string")
    from corvane.functions.urls import path_hash

    known = spark.createDataFrame([(d.replace("10.04", "10.0"), "logo")], "d string, file string").select(path_hash(F.col("d")).alias("hash"), "file")
    assert sweep.path_hits(sweep.lines(svg), known).first()["detail"] == "logo"


def test_ledger_and_gates(spark):
    new, old = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c")], "id string, v string"), spark.createDataFrame([("x", "1")], "v string, id string")
    got = ledger.append(new, old, "id")
    assert got.columns == ["v", "id"] and sorted(r["v"] for r in got.collect()) == ["b", "c"]
    assert tuple(ledger.appended(new, old, "id").first()) == (2, 1)
    assert ledger.append(got, got.unionByName(old), "id").count() == 0
    facts = gates.facts_row(spark, measured_system=True, lint_errors=1, design_md=True)
    r = gates.passes(gates.design(facts, "app")).first()
    assert (r["passed"], r["next_action"]) == (False, "Fix the design.")
    assert gates.passes(gates.design(facts, "migrate")).first()["passed"]
    t = F.col("t")
    d = spark.createDataFrame([("x\nDecision: go, rescoped\n", True), ("Decision: maybe", False), ("Decision: no-go", True)], "t string, ok boolean")
    assert d.where(gates.decision(t) != F.col("ok")).count() == 0


def test_interactions(spark):
    base, focused = {"color": "a", "outlineStyle": "none"}, {"color": "b", "outlineStyle": "none"}
    df = spark.createDataFrame([(base, focused)], "a map<string,string>, b map<string,string>")
    r = df.select(M.focus_visible(F.col("a"), F.col("b")).alias("f"), M.focus_visible(F.col("a"), F.col("a")).alias("g"), M.style_change(F.col("a"), F.col("b")).alias("c")).first()
    assert (r["f"], r["g"], r["c"]) == (True, False, {"color": ["a", "b"]})


def test_crawl_shuffles_links_once(spark):
    """Of links that are settled, nothing is dealt out or sorted again, also where no side can be broadcast."""
    small = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    plans, real = [], migrate._settled
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    rows = migrate.SMALL_ROWS if hasattr(migrate, "SMALL_ROWS") else None
    try:
        migrate.SMALL_ROWS = 0
        spark.conf.set("spark.sql.adaptive.enabled", "false")

        def spy(df, *key):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return real(df, *key)

        migrate._settled = spy
        links = spark.range(1, 400).selectExpr("concat('http://x.example/', cast(id div 2 as string)) src", "concat('http://x.example/', cast(id as string)) dst").where("src <> dst")
        links = links.union(links).union(links.selectExpr("dst src", "src dst"))
        start = spark.createDataFrame([("http://x.example/1",), ("http://x.example/1",)], "url string")
        got = {r["url"]: r["level"] for r in migrate.crawl(start, links).collect()}
    finally:
        migrate._settled, migrate.SMALL_ROWS = real, rows
        for k, v in small.items():
            spark.conf.set(k, v)
    assert got == {f"http://x.example/{i}": i.bit_length() - 1 if i else 1 for i in range(400)}
    steps = [p for p in plans if "LeftAnti" in p]
    assert len(steps) > 7 and all(p.count("Exchange") == 1 for p in steps)


def test_crawl_has_no_depth_limit(spark):
    links = spark.createDataFrame([(f"http://x.example/{i}", f"http://x.example/{i + 1}") for i in range(55)], "src string, dst string")
    start = spark.createDataFrame([("http://x.example/0",)], "url string")
    assert {(r["url"], r["level"]) for r in migrate.crawl(start, links).collect()} == {(f"http://x.example/{i}", i) for i in range(56)}
    assert migrate.crawl(start, links, depth=3).count() == 4 and migrate.crawl(start, links, most=3).count() == 3


def test_title_case_reads_the_whole_heading(spark):
    heads = [(1, "Start " + "Word " * 10_000 + "low " * 10_000), (2, "Start " + "Word " * 9 + "low")]
    got = spark.createDataFrame(heads, "k int, t string").select("k", lint.is_title_case(F.col("t")).alias("title")).collect()
    assert {r["k"]: r["title"] for r in got} == {1: False, 2: True}


def test_state_is_saved_and_read(spark, tmp_path):
    from corvane.operators import gates

    s = gates.new_state(spark, "app")
    gates.save_state(s, str(tmp_path / "s"))
    assert [tuple(r) for r in gates.load_state(spark, str(tmp_path / "s")).collect()] == [("research", "app", {})]
    spark.createDataFrame([("nowhere", "site", None)], gates.STATE).coalesce(1).write.json(str(tmp_path / "t"))
    assert [tuple(r) for r in gates.load_state(spark, str(tmp_path / "t")).collect()] == [("research", "site", {})]
    facts = gates.facts_row(spark, measured_system=True, lint_errors=4, design_md=True, host_design=True)
    status = lambda mode: {r["name"]: r["status"] for r in gates.design(facts, mode).collect()}
    assert status("feature")["lint"] == "pass" and status("app")["lint"] == "fail" and status("migrate")["lint"] == "skip"


def test_queue_ends_at_its_limits(spark):
    from corvane.operators import migrate

    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 0), ("a", "b", 5), ("c", "d", 0), ("b", "e", 0), ("c", "a", 1)], "src string, dst string, pos long")
    start = spark.createDataFrame([("a", 0)], "url string, pos long")
    answers = spark.createDataFrame([(u, u != "e", 200 if u != "d" else 500, 4 if u == "b" else 0) for u in "abcde"], "url string, allowed boolean, status int, slow int")
    got = lambda **kw: {r["url"]: r["state"] for r in migrate.crawl_queue(start, links, answers, **kw).collect()}
    assert got(slowdowns=9) == {"a": "ok", "c": "ok", "b": "ok", "d": "failed", "e": "blocked"}
    assert got(most=2, slowdowns=9) == {"a": "ok", "c": "ok", "b": "left", "d": "left"}
    assert got() == {"a": "ok", "c": "ok", "d": "left"}  # b asks a fourth time to slow down and is not put back
    assert got(most=0) == {"a": "left"}
    assert migrate.queue_totals(migrate.crawl_queue(start, links.limit(0), answers.limit(0))).first().asDict() == {"pages": 0, "blocked": 0, "failed": 1, "left": 0}


def test_advance_keeps_the_next_stages_gate(spark):
    policy = "spark.sql.mapKeyDedupPolicy"
    gate = {"research": (False, "then"), "design": (True, "then")}
    state = spark.createDataFrame([("research", gate), ("design", gate)], "stage string, gates map<string,struct<passed:boolean,at:string>>")
    result = spark.createDataFrame([("research", True), ("design", False)], "stage string, passed boolean")
    was = spark.conf.get(policy)
    spark.conf.set(policy, "EXCEPTION")
    try:
        rows = gates.advance(state, result, F.lit("now")).collect()
    finally:
        spark.conf.set(policy, was)
    got = sorted((r["stage"], {k: tuple(v) for k, v in r["gates"].items()}["research"], tuple(r["gates"]["design"])) for r in rows)
    assert got == [("design", (False, "then"), (False, "now")), ("design", (True, "now"), (True, "then"))]
