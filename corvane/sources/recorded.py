"""A Python data source over recorded responses: the engine's stand-in for live HTTP.

Responses are files <folder>/<sha1 of the URL>.json with url, status, declared length and text; the folder must be
mounted on every executor (`answers_of` reads the same files through Spark's own file system instead). One partition a
slice of URLs, or, with option `template`, one a country: its pages in order until one is missing or empty; a template
may name {since}, so that the feed itself leaves out what is older than option `since`. A missing recording is status 0.
Bodies whose declared or own size is over the limit are reported as too big, not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MOST_BYTES, TIMEOUT_S = 5_000_000, 20
SCHEMA = "url string, status int, location string, too_big boolean, text string"


def file_of(folder: str, url: str) -> str:
    return os.path.join(folder, hashlib.sha1(url.encode()).hexdigest() + ".json")


def record(folder: str, url: str, status: int, text: str = "", location: str | None = None, length: int | None = None) -> None:
    """Save a response, for fixtures."""
    with open(file_of(folder, url), "w", encoding="utf-8") as f:
        json.dump({"url": url, "status": status, "text": text, "location": location, "length": length}, f)


def answers_of(spark, folder: str) -> DataFrame:
    """Every recording of a folder, read by Spark: the columns of SCHEMA."""
    raw = spark.read.schema("url string, status int, text string, location string, length long").json(folder)
    big = (F.coalesce("length", F.lit(0)) > MOST_BYTES) | (F.octet_length("text") > MOST_BYTES)
    return raw.select("url", "status", "location", F.coalesce(big, F.lit(False)).alias("too_big"), F.when(~big, F.col("text")).alias("text"))


def json_answers(answers: DataFrame, schema: str) -> DataFrame:
    """url, value, error: the parsed JSON, or what went wrong (a status of 400 and above, a text that is no JSON)."""
    value, failed = F.from_json("text", schema), F.col("status") >= 400
    is_json = F.try_parse_json("text").isNotNull()
    error = F.when(failed | (F.col("status") == 0), F.concat(F.col("status").cast("string"), F.lit(" from "), F.col("url"))).when(~is_json, F.concat(F.lit("Not JSON from "), F.col("url"), F.lit(" (status "), F.col("status").cast("string"), F.lit(")")))
    return answers.select("url", F.when(error.isNull(), value).alias("value"), error.alias("error"))


class Slice(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class Country(InputPartition):
    def __init__(self, country: str):
        self.country = country


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.urls = options["folder"], json.loads(options.get("urls", "[]"))
        self.template, self.most = options.get("template"), int(options.get("most", 10))
        self.countries, self.since = json.loads(options.get("countries", "[]")), options.get("since", "")
        self.slices = max(1, int(options.get("slices", 4)))
        self.delay_ms = int(options.get("delay_ms", 0))

    def partitions(self) -> list[InputPartition]:
        if self.template:
            return [Country(c) for c in self.countries]
        return [Slice(self.urls[i :: self.slices]) for i in range(self.slices) if self.urls[i :: self.slices]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Country):
            for page in range(1, self.most + 1):
                row = answer(self.folder, self.template.format(country=partition.country, page=page, since=self.since))
                if row[1] != 200 or not row[4]:
                    return
                yield row
            return
        for i, url in enumerate(partition.urls):
            if i and self.delay_ms:
                time.sleep(self.delay_ms / 1000)
            yield answer(self.folder, url)


def answer(folder: str, url: str) -> tuple:
    path = file_of(folder, url)
    if not os.path.exists(path):
        return url, 0, None, False, None
    with open(path, encoding="utf-8") as f:
        r = json.load(f)
    big = (r.get("length") or 0) > MOST_BYTES or len((r.get("text") or "").encode()) > MOST_BYTES
    return url, int(r["status"]), r.get("location"), big, None if big else r.get("text")


class PagedStream(SimpleDataSourceStreamReader):
    """Pages of a feed, one an offset, until a page is missing or empty: a pull with stop conditions as a stream."""

    def __init__(self, options: dict):
        self.folder, self.template, self.most = options["folder"], options["template"], int(options.get("most", 10))

    def initialOffset(self) -> dict:
        return {"page": 1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page = start["page"]
        if page > self.most:
            return iter([]), start
        row = answer(self.folder, self.template.format(page=page))
        if row[1] != 200 or not row[4]:
            return iter([]), start
        return iter([row]), {"page": page + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([answer(self.folder, self.template.format(page=p)) for p in range(start["page"], end["page"])])


class Recorded(DataSource):
    """spark.read.format("recorded").option("folder", ...).option("urls", JSON array)."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options)

    def simpleStreamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def register(spark) -> None:
    spark.dataSource.register(Recorded)
