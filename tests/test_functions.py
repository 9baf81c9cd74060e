from pyspark.sql import functions as F

from corvane.functions import color as C
from corvane.functions import html as H
from corvane.functions import text as T
from corvane.functions import urls as U


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values()) or (1,)], list(cols) or ["one"])
    return df.select(expr.alias("x")).first()["x"]


def test_text(spark):
    t = F.col("t")
    assert one(spark, T.squash(t), t="  a  b\n c ") == "a b c"
    assert one(spark, T.fold(t), t="“It’s” — so…") == "\"It's\" - so..."
    assert one(spark, T.fold(t, normalize=True), t="ﬁne") == "fine"
    assert one(spark, T.words(t), t="Don't 'quote' ÉTÉ 42!") == ["don't", "quote", "été", "42"]
    assert one(spark, T.ident_words(t), t="CalendlyEmbed_v2HTMLPage") == ["calendly", "embed", "v", "2", "html", "page"]
    assert one(spark, T.contains_run(T.ident_words(t), F.array(F.lit("cal"))), t="calendar cal") is True
    assert one(spark, T.contains_run(T.ident_words(t), F.array(F.lit("cal"))), t="calendar") is False
    assert one(spark, T.contains_run(T.ident_words(t), F.array().cast("array<string>")), t="calendar") is False
    assert one(spark, T.sentences(t), t="One. Two!\nThree? ") == ["One.", "Two!", "Three?"]
    assert one(spark, T.shingles(F.split(t, " "), 3), t="a b c d") == ["a b c", "b c d"]
    assert one(spark, T.shingles(F.split(t, " "), 3), t="a b") == []
    assert one(spark, T.slug(t), t="https://Ex.com/A  B/") == "ex-com-a-b"
    assert one(spark, T.slug(t), t="!!") == "page"
    assert one(spark, T.graphemes(t), t="Hi 👋🏽") == 4
    assert one(spark, T.has_emoji(t), t="go 🚀") and not one(spark, T.has_emoji(t), t="go")
    assert one(spark, T.similarity(t, F.lit("")), t="") == 1.0
    assert abs(one(spark, T.similarity(t, F.lit("KITTEN")), t="sitting") - (1 - 3 / 7)) < 1e-12
    assert one(spark, T.round_half_up(F.col("v")), v=-2.5) == -2.0
    assert one(spark, T.truncate(t, 4), t="abcdef") == "abc…"


def test_colors(spark):
    hexed = lambda s: one(spark, C.to_hex(C.parse_color(F.col("t"))), t=s)
    assert {hexed(s) for s in ("#ff0000", "#f00", "rgb(255,0,0)", "rgb(100% 0% 0%)", "hsl(0,100%,50%)", "red", "oklch(0.628 0.2577 29.23)")} == {"#ff0000"}
    assert one(spark, C.parse_color(F.col("t"))["r"], t="nope") is None
    black, white = C.parse_hex(F.lit("#000")), C.parse_hex(F.lit("white"))
    assert abs(one(spark, C.contrast(black, white)) - 21) < 1e-9
    assert abs(one(spark, C.contrast(white, black)) - 21) < 1e-9
    assert one(spark, C.contrast(C.parse_hex(F.lit("#777")), white)) < 4.5
    assert one(spark, C.chroma(C.oklab(C.parse_hex(F.lit("#808080"))))) < 0.001
    assert one(spark, C.distance(C.oklab(black), C.oklab(black))) == 0
    assert one(spark, C.to_hex(C.over(C.parse_hex(F.lit("#00000080")), white))) == "#7f7f7f"
    assert one(spark, C.colors_in_text(F.col("t")), t="a #fff b rgba(1,2,3,.5) #12345") == ["#fff", "rgba(1,2,3,.5)"]
    assert one(spark, C.hue_gap(F.lit(350.0), F.lit(10.0))) == 20


def test_html(spark):
    t = F.col("t")
    page = "<html><head><title> A &amp; B </title><meta name='description' content='D'><link rel='canonical' href='/c'></head><body><nav>n</nav><main><h1>Hi <b>you</b></h1><ul><li>a</li><li>b</li></ul><p>x<br>y &#8217;</p></main></body></html>"
    assert one(spark, H.html_to_text(H.content_of(t)), t=page) == "# Hi you\n\n- a\n- b\n\nx\ny ’"
    h = one(spark, H.head_of(t), t=page)
    assert (h["title"], h["description"], h["canonical"], h["robots"], h["h1"]) == ("A & B", "D", "/c", "", "Hi you")
    assert one(spark, H.links_of(t, F.lit("http://e.com/x/")), t="<a href='b#f'>1</a><a href=\"mailto:q\">2</a><a href=/c>3</a><a href='b'>4</a>") == ["http://e.com/x/b", "http://e.com/c"]
    assert one(spark, H.decode_entities(t), t="&amp;lt; &#x41; &nope; &mdash;") == "&lt; A &nope; -"
    assert one(spark, H.decode_named(t), t="&amp;lt; &copy;") == "&lt; (c)"
    assert one(spark, H.sitemap_urls(t), t="<loc> http://a?x=1&amp;y=2 </loc>") == ["http://a?x=1&y=2"]
    assert one(spark, H.html_to_text(t), t=None or "") == ""


def test_urls(spark):
    t = F.col("t")
    assert one(spark, U.normalize(t), t="http://a.com/x/?utm_source=1&b=2&ref=q#f") == "http://a.com/x/?b=2"
    assert one(spark, U.normalize_exact(t), t="http://A.com/x/?utm_source=1&b=2#f") == "http://a.com/x?b=2"
    assert one(spark, U.host(t), t="https://www.Ex.com/a") == "ex.com"
    assert one(spark, U.canonical_path(t), t="https://e.com/a/") == "/a"
    assert one(spark, U.in_section(t, "e.com", "/docs"), t="https://e.com/docs/x") is True
    assert one(spark, U.in_section(t, "e.com", "/docs"), t="https://e.com/docsx") is False
    assert one(spark, U.app_id(t), t="https://apps/app/id123456789?x") == "123456789"
    a = "M1.04 2.0L3,4"
    assert one(spark, U.path_hash(t), t=a) == one(spark, U.path_hash(t), t="M 1.0 2 L 3 4")
    assert one(spark, U.path_hash(t), t=a) != one(spark, U.path_hash(t), t="M1.1 2 L3 4")
    assert one(spark, U.longest_ms(t), t="0.2s, 150ms") == 200
    assert one(spark, U.domain_status(F.lit(404), F.lit(None), F.lit(None))) == "free"
    assert one(spark, U.domain_status(F.lit(None), F.lit(0), F.lit(2))) == "taken"
    assert one(spark, U.name_of(t), t="https://app.calmly.io/x") == "Calmly"
