"""Every query against its SQL, on the smallest tables."""

import binascii
import math
import re

import pytest

from oscine.operators import statistics
from oscine.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, name):
    found = catalog.queries()[name](spark, FOLDER)
    twin = db.sql(catalog.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(twin.columns)
    at = [list(twin.columns).index(c) for c in columns]
    want = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in twin.fetchall())
    assert sorted(repr(tuple(_plain(x) for x in r)) for r in found.select(columns).collect()) == want


@pytest.mark.parametrize("name", ["frame_roundtrip", "highpass_rms", "welch_features", "resample_error", "bootstrap_ci", "signed_rank", "streaming_cusum", "feature_vector", "trial_features", "group_tests"])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_contract_rules_at_the_limit(spark, tmp_path):
    cents = [9, 1, 7, 4, 0, 0, 2, 10, 9, 7, 5, 5, 0, 4, 7, 3, 6, 8, 8, 10, 1, 3, 9, 8, 2]  # a mean of 0.0512; added in this order as doubles, more
    series = {1: cents, 2: sorted(cents), 3: [*cents[:-1], 3], 4: [*cents, None], 5: [*cents, math.nan], 6: [None]}
    rows = [(k, None if c is None else c / 100, "N", 50.0) for k, v in series.items() for c in v]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_returnflag string, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalog.queries()["contract_rules"](spark, str(tmp_path))
    assert {r.l_suppkey for r in found.where("rule = 'discount'").collect()} == {3, 5}


def test_contract_rules_without_a_flag(spark, tmp_path):
    rows = [(k, 0.05, flag, 50.0) for k, flags in {1: ["R", None, None], 2: ["R", "R", None], 3: [None]}.items() for flag in flags]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_returnflag string, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalog.queries()["contract_rules"](spark, str(tmp_path))
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalog.oracle_sql()["contract_rules"]).fetchall())
    assert {r.l_suppkey for r in found.where("rule = 'returned'").collect()} == {2}


def test_exact_mean(spark):
    series = {1: [1e30, 1.0], 2: [1e-25, 3e-25], 3: [math.inf, 1.0], 4: [None, None], 5: [0.1, 0.2, None], 6: [-0.1, 0.1]}
    rows = spark.createDataFrame([(k, x) for k, v in series.items() for x in v], "k int, x double")
    found = {r.k: r.m for r in rows.groupBy("k").agg(statistics.exact_mean("x").alias("m")).collect()}
    assert found == {1: 5e29, 2: pytest.approx(2e-25, rel=1e-12), 3: math.inf, 4: None, 5: 0.15, 6: 0.0}


def test_report_blocks_all(spark, tmp_path):
    texts = ["Alpha one.\nplain\nBeta two.\ntail", "low first\nGamma.\n", "", "no head", None, "Delta.\nEpsilon.", "Zeta"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t in enumerate(texts):
        block = 0
        for line in t.split("\n") if t is not None else ():
            block += bool(re.search(r"^[A-Z][a-z]+.*[.]$", line))
            lines, chars = want.get((i, block), (0, 0))
            want[i, block] = (lines + 1, chars + len(line))
    found = catalog.queries()["report_blocks_all"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.block): (r.lines, r.chars) for r in found} == want and len(found) == len(want)


def test_frame_crc_all(spark, tmp_path):
    names = ["Customer#000000001", "Customer#000000002", "Customer#000000300", "", "a", "é ß 漢", None, "long " * 60]
    rows = [(250 + 25 * k, x) for k, x in enumerate(names)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    found = {r.c_custkey: r.crc for r in catalog.queries()["frame_crc_all"](spark, str(tmp_path)).collect()}
    assert found == {k: None if x is None else binascii.crc_hqx(x.encode(), 0xFFFF) for k, x in rows}
