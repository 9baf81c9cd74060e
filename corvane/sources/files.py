"""File scans and sinks: CSV ledgers, JSON documents, text trees, listings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

MOST_BYTES = 2_000_000
# Folders and files that a text scan leaves out.
SKIP_DIRS = (
    "node_modules", ".git", ".next", ".nuxt", ".svelte-kit", ".astro", ".turbo", ".vercel", ".cache", ".output", "dist", "build", "out",
    "coverage", "vendor", "target", "__pycache__", ".venv", "venv", ".idea", ".vscode", "Pods", ".expo",
)
SKIP_FILES = r"(?i)\.(png|jpe?g|gif|webp|avif|ico|bmp|tiff?|mp4|mov|webm|mp3|wav|ogg|woff2?|ttf|otf|eot|pdf|zip|gz|tgz|rar|7z|dmg|exe|dll|so|dylib|class|jar|wasm|lockb?|db|sqlite3?|parquet|arrow)$|\.min\.(js|css)$"


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A ledger with RFC 4180 quoting, every cell text."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    return (r.schema(schema) if schema else r).csv(path)


@udtf(returnType="pos: int, cells: array<string>")
class TolerantCsv:
    """Records of a CSV text: quotes may open inside a cell, carriage returns outside quotes are dropped."""

    def eval(self, text: str) -> Iterator[tuple]:
        for pos, row in enumerate(parse_csv(text)):
            yield pos, row


def parse_csv(text: str | None) -> list[list[str]]:
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    quoted, s = False, (text or "").removeprefix("\ufeff")
    at, n = 0, len(s)
    while at < n:
        ch = s[at]
        if quoted and ch == '"' and s[at + 1 : at + 2] == '"':
            cell.append('"')
            at += 1
        elif ch == '"':
            quoted = not quoted
        elif quoted or ch not in ",\r\n":
            cell.append(ch)
        elif ch != "\r":
            row.append("".join(cell))
            cell = []
            if ch == "\n":
                rows.append(row)
                row = []
        at += 1
    if cell or row:
        rows.append([*row, "".join(cell)])
    return rows


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Quotes only where needed, nulls empty, LF endings."""
    df.na.fill("").write.mode(mode).option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def csv_line(columns: list[str]) -> Column:
    """One CSV record of a row as text."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quote = lambda v: F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.concat_ws(",", *[quote(cell(c)) for c in columns])


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file; unreadable ones become rows of nulls with _corrupt_record, if the schema has it."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines, nulls kept, so that json-lines readers see every key."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_text(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """One text column as lines; parts end in one line break."""
    df.select(F.regexp_replace(F.coalesce(column, F.lit("")), r"\n+$", "").alias("value")).write.mode(mode).text(path)


def is_binary(content: Column) -> Column:
    """A NUL byte in the first 8192."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def text_tree(spark: SparkSession, root: str, most: int = MOST_BYTES) -> DataFrame:
    """path, content of the text files below a folder: tool folders, binaries, minified and large files left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    dirs = "|".join(d.replace(".", r"\.") for d in SKIP_DIRS)
    kept = files.where((F.col("length") <= most) & ~F.col("path").rlike(f"/(?:{dirs})/") & ~F.col("path").rlike(SKIP_FILES))
    return kept.where(~is_binary(F.col("content"))).select("path", F.decode("content", "UTF-8").alias("content"))


def files_in(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """path of the entries of a folder with one of the extensions in any letter case, sorted.

    An entry can be a folder itself, as tables in several parts are; its parts are not listed. Names that begin with _ or . are
    left out, as Spark's readers do.
    """
    ext = "|".join(e.lstrip(".").replace(".", r"\.") for e in extensions)
    paths = spark.createDataFrame([(p,) for p in _entries(spark, folder)], "path string")
    return paths.where(F.col("path").rlike(rf"(?i)\.(?:{ext})$") & ~F.col("path").rlike("/[_.][^/]*$")).orderBy("path")


def _entries(spark: SparkSession, folder: str) -> list[str]:
    """Paths of a folder's entries, by Hadoop's file systems, so that any store that Spark reads can be listed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = lambda found: list(hadoop.FileUtil.stat2Paths(found) or [])
    folders = paths(fs.globStatus(at))
    if not folders:
        raise FileNotFoundError(folder)
    return [p.toString() for f in folders for p in paths(fs.listStatus(f))]


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Measurement files: JSON, without interaction sweeps."""
    return files_in(spark, folder, ["json"]).where(~F.col("path").rlike(r"(?i)\.interact\.json$"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """http(s) lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url").rlike("^https?://"))


def with_images(measured: DataFrame) -> DataFrame:
    """Measurement paths joined with the image of the same stem, where both exist (path of every file in, json and png out)."""
    stem = F.regexp_replace("path", r"\.(json|png)$", "")
    side = lambda ext: measured.where(F.endswith("path", F.lit(f".{ext}"))).select(stem.alias("stem"), F.col("path").alias(ext))
    return side("json").join(side("png"), "stem").select("stem", "json", "png")


@udtf(returnType="key: string, value: string")
class JsonLeaves:
    """Every string leaf of a JSON text with its dotted and indexed path; none of a broken text."""

    def eval(self, text: str) -> Iterator[tuple]:
        import json as parser

        try:
            stack = [("", parser.loads(text))] if text else []
        except ValueError:
            return
        while stack:
            key, v = stack.pop()
            if isinstance(v, str):
                yield key, v
            elif isinstance(v, list):
                stack += [(f"{key}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
            elif isinstance(v, dict):
                stack += [(f"{key}.{k}" if key else k, x) for k, x in reversed(v.items())]


@udtf(returnType="type: string")
class JsonLdTypes:
    """Types in a JSON-LD text, through graphs and nested objects."""

    def eval(self, text: str) -> Iterator[tuple]:
        import json as parser

        try:
            stack = [parser.loads(text)] if text else []
        except ValueError:
            return
        seen = set()
        while stack:
            v = stack.pop()
            if isinstance(v, list):
                stack += reversed(v)
            elif isinstance(v, dict):
                t = v.get("@type")
                for x in t if isinstance(t, list) else [t]:
                    if isinstance(x, str) and x not in seen:
                        seen.add(x)
                        yield (x,)
                stack += [x for x in v.values() if isinstance(x, (dict, list))]
