"""The registered queries against DuckDB where there is SQL, and the pipeline on a planted corpus."""

import glob
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quernel.llm import queries

from .test_operators import long_text

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_duckdb(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, DIR)
    order = sorted(df.columns)
    other = c.execute(f"SELECT {', '.join(order)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, df.select(*order).toPandas().replace({np.nan: None}).astype(object).values.tolist())) == sorted(map(str, ([float(x) if n == "refers_to" and x is not None else x for n, x in zip(order, r, strict=True)] for r in other)))


def test_pipeline(spark, tmp_path):
    secret = "q7Zp0aVx93LmTr5KdW8sYb2NcEhJ4uGf"
    copy = long_text(200, 50)
    rows = [(i, long_text(120, i), "en", "web") for i in range(20)]
    rows += [(100 + i, copy, "en", "hot") for i in range(30)] + [(200, copy + " tail", "en", "web"), (300, "too short", "en", "web"), (301, None, None, None), (302, "", "en", "web"), (None, long_text(90, 77), "en", None)]
    rows += [(400, f'{long_text(100, 60)} api_key = "{secret}" end', "en", "src"), (401, "again and again " * 60, "en", "web"), (20, long_text(100, 20), "de", None), (20, long_text(100, 20), "de", None)]
    docs = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r["text"] for r in at.collect()})
        if name == "near_duplicates":
            assert at.count() == len(kept[-1])
    clean = {*range(21), 400, None}
    # copies of one text count once, so quality rules leave them alone; near_duplicates keeps one of them and of 200
    assert set(kept[0]) == clean | {200} | set(range(100, 130))
    assert set(kept[1]) == clean | {100}
    assert secret not in kept[2][400] and kept[2][400].endswith("end") and all(kept[2][i] == kept[1][i] for i in kept[1] if i != 400)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept[2])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "best_fit_packing"]
