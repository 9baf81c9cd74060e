"""Every pipeline stage on odd tables: nulls everywhere, empty and very long texts, repeats, clashing names, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("mix_copies", "mix_rate", "doc", "fp", "sim_id", "sim_key", "score", "spans", "root", "id", "value", "label", "u", "v", "variant", "toxic")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    rows = [(i, f"plain words of document {i} " * 6 + (" vilestem nastyish" if i % 3 == 0 else ""), "en", "s", 9) for i in range(60)]
    rows += [(None,) * 5, (70, None, None, None, None), (71, "", "", "", 0), (72, " \n\t", "en", "s", 3), (73, "long " * 300_000 + "tail", "en", "s", 9), (1, rows[1][1], "en", "s", 9), (1, "another text of document one, quite unlike it", "en", "t", 9)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    docs.write.parquet(str(path / "documents.parquet"))
    docs.limit(0).write.parquet(str(path / "empty.parquet"))
    spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stage_on_odd_rows(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder).persist()
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    if name == "packing":
        assert {None, 70, 71, 72, 73} <= set(ids)
    else:
        assert out.schema.names == docs.schema.names
        assert {tuple(r[c] for c in CLASH) for r in out.collect()} == {tuple(range(len(CLASH)))}
    if name == "toxicity":
        assert {None, 70, 71, 72, 73} <= set(ids) and sum(i is not None and i < 60 and i % 3 == 0 for i in ids) <= 2
    if name == "simhash_near_dedup":
        texts = [r["text"] for r in out.where("doc_id = 1").collect()]
        assert len(texts) == 2 and None in ids and sum(i in (70, 71, 72) for i in ids) == 1
    if name == "secret_scan":
        assert out.count() == docs.count()
    assert stage(spark, spark.read.parquet(f"{folder}/empty.parquet"), folder).count() == 0


LONG = """
import sys
import pyarrow as pa, pyarrow.parquet as pq
from corvane.session import build
import corpus_pipeline as P
text = [chr(97 + i % 26) * 400_000 + str(i) for i in range(1_000)]
pq.write_table(pa.table({"doc_id": range(1_000), "text": text}), sys.argv[1], use_dictionary=False)
del text
spark = build(2, memory="512m", **{"spark.checkpoint.dir": sys.argv[2]})
print("kept", P.near_dedup_stage(spark, spark.read.parquet(sys.argv[1]), "").count())
"""


def test_long_texts_are_not_read_by_thousands(tmp_path):
    """A thousand texts of 400,000 letters in one row group, with a heap of 512 MB."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(P.__file__))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": root}
    run = subprocess.run([sys.executable, "-c", LONG, str(tmp_path / "d.parquet"), str(tmp_path / "ckpt")], env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "kept 1000" in run.stdout, run.stderr[-1000:]
