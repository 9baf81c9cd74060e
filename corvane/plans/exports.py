"""Exporters over regions and nations, as numbered lines; and file sinks read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.common import table
from corvane.session import shared_folder
from corvane.sources import exporters as X
from corvane.sources import files


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "pos long, line string")


def _regions(spark: SparkSession, d: str) -> list:
    """The five regions in order: reports are small by definition."""
    return X.rows_of(table(spark, d, "region").orderBy("r_regionkey").select("r_regionkey", F.lower("r_name").alias("n")), 25)


def _design(spark: SparkSession, d: str) -> dict:
    r = _regions(spark, d)
    return {"name": "Regions", "colors": {n: f"#00000{k}" for k, n in r} | {"accent": "#123456"}, "dark": {r[0][1]: "#ffffff"}, "rounded": {"md": "4px"}, "spacing": {"a": 8}, "typography": {"body": {"fontFamily": "Inter", "fontSize": "16px"}}, "motion": {"fast": "90ms"}}


def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, X.markdown_table(["Key", "Name"], [[k, None if k == 0 else f"{n}|x"] for k, n in _regions(spark, d)]))


def export_table(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, X.text_table(["Key", "Name"], [[k, n * 9 if k == 1 else n] for k, n in _regions(spark, d)], most=12))


def export_yaml(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(spark, d)
    return _lines(spark, X.to_yaml({"kind": "regions", "none": None, "empty": [], "yes": True, "regions": [{"key": k, "name": f"{n}: it" if k == 0 else n} for k, n in r]}))


def export_css(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, X.design_css(_design(spark, d)))


def export_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the design tokens."""
    t = X.design_tokens(_design(spark, d))
    return spark.createDataFrame([(g, k, json.dumps(v["$value"]), v["$type"]) for g, kv in t.items() if isinstance(kv, dict) for k, v in kv.items()], "grp string, name string, value string, type string")


def export_theme(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(spark, d)
    return _lines(spark, X.component_theme({"colors": {"canvas": f"#{len(r[0][1])}{len(r[1][1])}f", "ink": "#111111", "accent": "#006bff"}, "rounded": {"pill": "9999px", "lg": "8px"}, "dark": {"canvas": "#000000"}}))


def export_reviews(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(spark, d)
    themes = [{"kind": "hate" if k % 2 else "love", "label": n, "reviews": k, "sources": ["a"] * (k > 2) + ["b"], "thin": k < 3, "quotes": [{"text": f"q{k}", "url": "u"}] * 3} for k, n in r]
    return _lines(spark, X.review_report("it", {"reviews": 5}, themes, [{"id": "x", "rating": "1", "text": "a|b"}]))


def export_system(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(spark, d)
    return _lines(spark, X.system_report({"colors": {"ink": "#111111"}, "scale": [{"size": k, "line_height": "1.5", "weight": "400", "family": n, "share": k / 2} for k, n in r], "base": 4, "spacing": [k * 4 for k, _ in r]}))


def export_teardown(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, X.teardown_report({n: "" if k == 3 else f"# Title {k}\n\ntext\n## Part" for k, n in _regions(spark, d)}))


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one; it stays, as the result reads it."""
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nations written as a CSV ledger and read back, every cell text."""
    path = _folder(spark)
    n = table(spark, d, "nation")
    cell = F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit(', "so"\nend'))).when(F.col("n_nationkey") % 4 == 1, F.lit(None)).otherwise(F.col("n_name"))
    files.write_csv(n.select(F.col("n_nationkey").cast("string").alias("k"), cell.alias("t")), path)
    return files.csv(spark, path).select("k", F.coalesce("t", F.lit("")).alias("t"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("n_name"))
    files.write_json(n, path)
    return spark.read.schema("n_nationkey int, n_name string").json(path).select("n_nationkey", F.coalesce("n_name", F.lit("none")).alias("n_name"))


def url_lines(spark: SparkSession, d: str) -> DataFrame:
    """Page URLs and other lines written as text; the http(s) ones read back."""
    path = _folder(spark)
    p = table(spark, d, "pages")
    files.write_text(p.select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("# "), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit(" "))).alias("t")), path, "t")
    return files.url_list(spark, path).groupBy("url").agg(F.count("*").alias("n"))


_R = "SELECT r_regionkey AS k, lower(r_name) AS n FROM region"
_HEADS = lambda *x: " UNION ALL ".join(f"SELECT {i}::DOUBLE AS o, '{t}' AS line" for i, t in x)


def _numbered(parts: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY o) - 1 AS pos, line FROM ({parts})"


QUERIES = {
    f.__name__: f
    for f in (export_markdown, export_table, export_yaml, export_css, export_tokens, export_theme, export_reviews, export_system, export_teardown, csv_round_trip, json_round_trip, url_lines)
}

ORACLES = {
    "export_markdown": _numbered(_HEADS((-2, "| Key | Name |"), (-1, "| --- | --- |")) + rf" UNION ALL SELECT k, '| ' || k || ' | ' || CASE WHEN k = 0 THEN '' ELSE n || '\|x' END || ' |' FROM ({_R})"),
    "export_table": _numbered(_HEADS((-1, "Key  Name")) + f" UNION ALL SELECT k, k || '    ' || CASE WHEN k = 1 THEN left(repeat(n, 9), 11) || '…' ELSE n END FROM ({_R})"),
    "export_yaml": _numbered(_HEADS((-4, "kind: regions"), (-3, "empty: []"), (-2, '"yes": true'), (-1, "regions:")) + f" UNION ALL SELECT k, '  - key: ' || k FROM ({_R}) UNION ALL SELECT k + 0.5, '    name: ' || CASE WHEN k = 0 THEN '\"' || n || ': it\"' WHEN contains(n, ' ') THEN n ELSE n END FROM ({_R})"),
    "export_css": _numbered(
        _HEADS((-9, ":root {"), (10, "  --accent: #123456;"), (11, "  --radius-md: 4px;"), (12, "  --space-a: 8px;"), (13, "  --font-body: Inter;"), (14, "  --text-body: 16px;"), (15, "  --motion-fast: 90ms;"), (16, "}"), (17, ""), (18, "@media (prefers-color-scheme: dark) {"), (19, "  :root {"), (21, "  }"), (22, "}"), (23, ""), (24, "@theme inline {"), (40, "  --color-accent: var(--accent);"), (41, "  --radius-md: var(--radius-md);"), (42, "  --font-body: var(--font-body);"), (43, "  --text-body: var(--text-body);"), (44, "}"), (45, ""))
        + f" UNION ALL SELECT k, '  --' || n || ': #00000' || k || ';' FROM ({_R}) UNION ALL SELECT 20, '    --' || n || ': #ffffff;' FROM ({_R}) WHERE k = 0 UNION ALL SELECT 30 + k, '  --color-' || n || ': var(--' || n || ');' FROM ({_R})"
    ),
    "export_tokens": f"""SELECT 'color' AS grp, n AS name, '"#00000' || k || '"' AS value, 'color' AS type FROM ({_R}) UNION ALL SELECT 'color-dark', n, '"#ffffff"', 'color' FROM ({_R}) WHERE k = 0
        UNION ALL SELECT * FROM (VALUES ('color', 'accent', '"#123456"', 'color'), ('radius', 'md', '"4px"', 'dimension'), ('spacing', 'a', '"8px"', 'dimension'), ('motion', 'fast', '"90ms"', 'duration'),
        ('typography', 'body', '{{"fontFamily": "Inter", "fontSize": "16px", "fontWeight": null, "lineHeight": null, "letterSpacing": "0"}}', 'typography'))""",
    "export_theme": f"""WITH c AS (SELECT '#' || length(min(n) FILTER (WHERE k = 0)) || length(min(n) FILTER (WHERE k = 1)) || 'f' AS c FROM ({_R})),
        v AS (SELECT * FROM (VALUES ('background', 'c'), ('foreground', '#111111'), ('card', 'c'), ('card-foreground', '#111111'), ('popover', 'c'), ('popover-foreground', '#111111'), ('primary', '#006bff'), ('secondary', 'c'), ('secondary-foreground', '#111111'), ('muted', 'c'), ('muted-foreground', '#111111'), ('accent', 'c'), ('accent-foreground', '#111111'), ('ring', '#006bff')) t(k, v)),
        w AS (SELECT row_number() OVER () AS i, k, v FROM v)
        {_numbered(_HEADS((-2, ":root {"), (-1, "  --radius: 8px;"), (50, "}"), (51, ""), (52, ".dark {"), (90, "}"), (91, "")) + " UNION ALL SELECT i, '  --' || k || ': ' || CASE WHEN v = 'c' THEN c ELSE v END || ';' FROM w, c UNION ALL SELECT 60 + i, '  --' || k || ': ' || CASE WHEN v = 'c' THEN '#000000' ELSE v END || ';' FROM w")}""",
    "export_reviews": _numbered(
        _HEADS((-9, "# What users say about it"), (-8, ""), (-7, "5 reviews."), (-6, ""), (-5, "Small sample: 5 reviews. Treat every theme as a lead to check, not a finding."), (-4, ""), (-3, "## What they hate (fix it)"), (-2, ""), (98, "## What they love (keep it, or lose them)"), (99, ""), (300, "## Low ratings no theme covers"), (301, ""), (302, "| Row | Rating | Review |"), (303, "| --- | --- | --- |"), (304, r"| x | 1 | a\|b |"), (305, ""))
        + f""" UNION ALL SELECT CASE WHEN k % 2 = 1 THEN 0 ELSE 100 END + k * 10, row_number() OVER (PARTITION BY k % 2 ORDER BY k) || '. **' || n || '**: ' || k || ' reviews across ' || CASE WHEN k > 2 THEN '2 sources (a, b)' ELSE '1 source (b)' END || CASE WHEN k < 3 THEN ', thin' ELSE '' END || '.' FROM ({_R}) WHERE k > 0
            UNION ALL SELECT CASE WHEN k % 2 = 1 THEN 0 ELSE 100 END + k * 10 + i, CASE WHEN i = 3 THEN '' ELSE '   > "q' || k || '" (u)' END FROM ({_R}), (VALUES (1), (2), (3)) t(i) WHERE k > 0"""
    ),
    "export_system": _numbered(
        _HEADS((0, "# The design system, as measured"), (1, ""), (2, "## Colors"), (3, ""), (4, "| Role | Color |"), (5, "| --- | --- |"), (13, ""), (14, "## Type"), (15, ""), (16, "| Size | Line height | Weight | Family | Share |"), (17, "| --- | --- | --- | --- | --- |"), (40, ""), (41, "## Spacing"), (42, ""), (44, ""))
        + f""" UNION ALL SELECT 5 + i, '| ' || r || ' | ' || CASE WHEN r = 'ink' THEN '#111111' ELSE 'none' END || ' |' FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS i, unnest(['canvas', 'surface', 'ink', 'ink_soft', 'accent', 'on_accent', 'border']) AS r)
            UNION ALL SELECT 20 + k, '| ' || k || ' | 1.5 | 400 | ' || n || ' | ' || (k / 2.0::DOUBLE)::VARCHAR || '% |' FROM ({_R}) UNION ALL SELECT 43, 'Base 4px. Scale: ' || string_agg((k * 4)::VARCHAR, ', ' ORDER BY k) || '.' FROM ({_R})"""
    ),
    "export_teardown": _numbered(_HEADS((-2, "# Teardown"), (-1, ""), (99, "")) + f""" UNION ALL SELECT k * 10 + i, CASE i WHEN 0 THEN '## ' || n WHEN 2 THEN 'text' WHEN 3 THEN '### Part' ELSE '' END FROM ({_R}), (VALUES (0), (1), (2), (3), (4)) t(i) WHERE k <> 3 AND NOT (k = 4 AND i = 4)"""),
    "csv_round_trip": """SELECT n_nationkey::VARCHAR AS k, CASE n_nationkey % 4 WHEN 0 THEN n_name || ', "so"' || chr(10) || 'end' WHEN 1 THEN '' ELSE n_name END AS t FROM nation""",
    "json_round_trip": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE 'none' END AS n_name FROM nation",
    "url_lines": "SELECT url, count(*)::BIGINT AS n FROM pages WHERE page_id % 3 <> 0 GROUP BY 1",
}
