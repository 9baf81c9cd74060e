import json

from pyspark.sql import functions as F

from corvane.operators.ledger import records
from corvane.sources import exporters as E
from corvane.sources import feeds, files, recorded
from corvane.streaming import ledger as streams


def test_csv(spark, tmp_path):
    assert files.parse_csv('﻿id,text\r\n1,"a ""q"", b\nc"\r\n2,x') == [["id", "text"], ["1", 'a "q", b\nc'], ["2", "x"]]
    (tmp_path / "a.csv").write_text('Id , Text\n1,"a ""q"", b\nc"\n2,\n')
    got = records(files.csv(spark, str(tmp_path / "a.csv"))).collect()
    assert [tuple(r) for r in got] == [("1", 'a "q", b\nc'), ("2", "")]
    line = spark.createDataFrame([("1", 'say "hi", ok')], "id string, t string").select(files.csv_line(["id", "t"])).first()[0]
    assert line == '1,"say ""hi"", ok"'
    files.write_csv(spark.createDataFrame([("1", None)], "id string, t string"), str(tmp_path / "o"))
    assert files.csv(spark, str(tmp_path / "o")).count() == 1


def test_trees(spark, tmp_path):
    for p, b in {"a.txt": b"hello", "b.bin": b"x\x00y", "node_modules/c.txt": b"no", "d.min.js": b"no", "m.json": b"{}", "m.interact.json": b"{}", "m.png": b"p"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b)
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.select("path").collect())
    assert names(files.text_tree(spark, str(tmp_path))) == ["a.txt", "m.interact.json", "m.json"]
    assert names(files.measurements(spark, str(tmp_path))) == ["m.json"]
    assert files.with_images(files.files_in(spark, str(tmp_path), ["json", "png"])).count() == 1


def test_tables_in_parts_are_listed_once(spark, tmp_path):
    spark.range(6).repartition(3).write.parquet(str(tmp_path / "t" / "many.parquet"))
    for p in ("one.PARQUET", "note.txt", "_left.parquet", "sub/deep.parquet", "sub/k=1/deep.parquet"):
        (tmp_path / "t" / p).parent.mkdir(exist_ok=True)
        (tmp_path / "t" / p).write_bytes(b"")
    got = [r["path"] for r in files.files_in(spark, str(tmp_path / "t"), [".Parquet"]).collect()]
    assert got == [f"file:{tmp_path}/t/many.parquet", f"file:{tmp_path}/t/one.PARQUET"]
    assert files.files_in(spark, str(tmp_path / "t"), [".csv"]).count() == 0


def test_recorded(spark, tmp_path):
    recorded.register(spark)
    recorded.record(str(tmp_path), "http://a/1", 200, "one")
    recorded.record(str(tmp_path), "http://a/2", 301, "", "http://a/1")
    df = spark.read.format("recorded").option("folder", str(tmp_path)).option("urls", json.dumps(["http://a/1", "http://a/2", "http://a/3"])).load()
    assert {r["url"]: r["status"] for r in df.collect()} == {"http://a/1": 200, "http://a/2": 301, "http://a/3": 0}


def test_feeds(spark):
    feed = {"feed": {"entry": [{"id": {"label": "7"}, "title": {"label": "Bad"}, "content": {"label": "Slow app"}, "updated": {"label": "2026-01-02T00:00:00"}, "im:rating": {"label": "1"}}, {"id": {"label": "x"}}]}}
    df = spark.createDataFrame([("12", "us", json.dumps(feed))], "app_id string, country string, j string").select("app_id", "country", F.from_json("j", feeds.REVIEW_FEED).alias("f")).select("app_id", "country", "f.feed")
    r = feeds.review_rows(df).collect()
    assert [(x["id"], x["date"], x["rating"], x["text"]) for x in r] == [("as-us-7", "2026-01-02", "1", "Bad. Slow app")]
    hits = {"hits": [{"objectID": "1", "created_at": "2026-01-01T1", "comment_text": "<p>It &amp; that is a long comment</p>"}, {"objectID": "2", "title": "short"}]}
    c = spark.createDataFrame([(json.dumps(hits),)], "j string").select(F.from_json("j", feeds.COMMENT).alias("h")).select("h.hits")
    assert [x["text"] for x in feeds.comment_rows(c).collect()] == ["It & that is a long comment"]
    boot = spark.createDataFrame([([[["com", "net"], ["https://r/"]]],)], "services array<array<array<string>>>")
    assert {(x["tld"], x["base"]) for x in feeds.registry_bases(boot).collect()} == {("com", "https://r/"), ("net", "https://r/")}


def test_udtfs(spark):
    out = files.JsonLeaves(F.lit('{"a": {"title": "T"}, "b": ["x", 1]}')).collect()
    assert [(r["key"], r["value"]) for r in out] == [("a.title", "T"), ("b[0]", "x")]
    assert [r["type"] for r in files.JsonLdTypes(F.lit('{"@graph": [{"@type": "Org"}, {"@type": ["A", "Org"]}]}')).collect()] == ["Org", "A"]
    assert [r["cells"] for r in files.TolerantCsv(F.lit('a,b"c,d"')).collect()] == [["a", "bc,d"]]


DESIGN = {"name": "Calm", "colors": {"canvas": "#fff", "ink": "#111", "accent": "#06f"}, "dark": {"canvas": "#000"}, "typography": {"body": {"fontFamily": "A, b", "fontSize": "16px"}}, "rounded": {"md": "8px"}, "spacing": {"a": 8}, "motion": {"fast": "150ms"}}


def test_exporters(spark):
    assert E.to_yaml({"a": "yes", "b": [1, {"c": "x: y"}], "d": None, "e": {}}) == 'a: "yes"\nb:\n  - 1\n  - c: "x: y"\ne: {}'
    assert "--primary: #06f;" in E.component_theme(DESIGN) and ".dark {" in E.component_theme(DESIGN)
    assert "--space-a: 8px;" in E.design_css(DESIGN) and "prefers-color-scheme: dark" in E.design_css(DESIGN)
    t = E.design_tokens(DESIGN)
    assert t["color"]["ink"] == {"$type": "color", "$value": "#111"} and t["motion"]["fast"]["$type"] == "duration"
    doc = E.design_document(DESIGN)
    assert doc.index("## Colors") < doc.index("## Typography") < doc.index("## Shapes") and "## Components" not in doc
    assert E.markdown_table(["a"], [["x|y\nz"]]).endswith("| x\\|y z |")
    assert "…" in E.text_table(["a"], [["x" * 80]])
    assert "Small sample" in E.review_report("X", {"reviews": 3}, [{"kind": "hate", "label": "L", "reviews": 1, "sources": ["a"], "thin": True}], [])
    assert E.teardown_report({"Part": "# T\n\n## S\nx"}) == "# Teardown\n\n## Part\n\n### S\nx\n"


def test_streaming_append(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(str(src / "1"))
    stream = lambda: spark.readStream.schema("id long, v string").option("recursiveFileLookup", True).parquet(str(src))
    streams.append_to(stream(), out, str(tmp_path / "c1"), "id").awaitTermination()
    spark.createDataFrame([(2, "z"), (3, "c")], "id long, v string").write.parquet(str(src / "2"))
    streams.append_to(stream(), out, str(tmp_path / "c1"), "id").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_paged_stream(spark, tmp_path):
    recorded.register(spark)
    for page in (1, 2):
        recorded.record(str(tmp_path), f"http://f/{page}", 200, f"page {page}")
    s = spark.readStream.format("recorded").option("folder", str(tmp_path)).option("template", "http://f/{page}").load()
    q = s.writeStream.format("memory").queryName("paged").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(4):
            q.processAllAvailable()
        assert sorted(r["text"] for r in spark.table("paged").collect()) == ["page 1", "page 2"]
    finally:
        q.stop()


def test_recorded_countries_sizes_and_json(spark, tmp_path):
    from corvane.sources import recorded

    recorded.register(spark)
    folder, template = str(tmp_path), "http://f/{country}/{page}"
    for country, pages in (("de", 3), ("fr", 1)):
        for p in range(1, pages + 1):
            recorded.record(folder, template.format(country=country, page=p), 200, "x" if (country, p) != ("de", 2) else "")
    import json as parser

    read = lambda countries: spark.read.format("recorded").option("folder", folder).option("template", template).option("countries", parser.dumps(countries)).load()
    got = read(["de", "fr", "it"])
    assert got.rdd.getNumPartitions() == 3
    # an empty page ends its own country, not the others
    assert sorted(r["url"] for r in got.collect()) == ["http://f/de/1", "http://f/fr/1"]
    recorded.record(folder, "http://big", 200, "small", length=recorded.MOST_BYTES + 1)
    recorded.record(folder, "http://json", 200, '{"a": 1}')
    recorded.record(folder, "http://err", 429, '{"a": 1}')
    recorded.record(folder, "http://html", 200, "<p>")
    rows = {r["url"]: r for r in recorded.answers_of(spark, folder).collect()}
    assert rows["http://big"]["too_big"] and rows["http://big"]["text"] is None and rows["http://json"]["text"] == '{"a": 1}'
    j = {r["url"]: r for r in recorded.json_answers(recorded.answers_of(spark, folder), "a int").collect()}
    assert j["http://json"]["value"]["a"] == 1 and j["http://json"]["error"] is None
    assert j["http://err"]["error"] == "429 from http://err" and j["http://html"]["error"] == "Not JSON from http://html (status 200)"


def test_json_and_text_sinks(spark, tmp_path):
    from corvane.sources import files

    df = spark.createDataFrame([(1, None), (2, "two\n\n")], "k int, t string")
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).orderBy("k").collect()[0]["t"] is None and '"t":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    files.write_text(df, str(tmp_path / "t"), "t")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["", "two"]


def test_low_bit_png():
    import struct
    import zlib

    import numpy as np

    from corvane.functions import png

    def make(depth, color, rows, palette=b"", width=5):
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, color, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")

    one = png.decode(make(1, 0, [bytes([0b10110000])]))
    assert one[0, :, 0].tolist() == [255, 0, 255, 255, 0] and (one[..., 3] == 255).all()
    two = png.decode(make(2, 3, [bytes([0b00011011, 0b01000000])], bytes(range(12))))
    assert two[0, :, :3].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11], [3, 4, 5]]
    four = png.decode(make(4, 0, [bytes([0x0F, 0x80, 0x10])]))
    assert four[0, :, 1].tolist() == [0, 255, 136, 0, 17]
    assert np.array_equal(png.decode(png.encode(two)), two)


def test_feeds_since_a_day(spark, tmp_path):
    import json as parser

    from corvane.sources import feeds, recorded

    recorded.register(spark)
    folder, template = str(tmp_path), "http://f/{country}/{page}?since={since}"
    recorded.record(folder, template.format(country="de", page=1, since="5"), 200, "new")
    recorded.record(folder, template.format(country="de", page=1, since=""), 200, "all")
    read = lambda **o: [r["text"] for r in spark.read.format("recorded").options(folder=folder, template=template, countries=parser.dumps(["de"]), **o).load().collect()]
    assert read(since="5") == ["new"] and read() == ["all"]
    hits = spark.createDataFrame([([(str(i), f"2024-01-0{i}T00:00:00Z", None, None, "a comment of some length here") for i in (1, 2, 3)],)], feeds.COMMENT)
    assert sorted(r["id"] for r in feeds.comment_rows(hits, "2024-01-02").collect()) == ["hn-2", "hn-3"] and feeds.comment_rows(hits).count() == 3
