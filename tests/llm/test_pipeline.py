import inspect
import os

import duckdb
import pytest
from helpers import components, documents, frame, prose, words

import check
import corpus_pipeline
from firmatlas.llm import mixing
from firmatlas.llm.queries import ORACLE, QUERIES

FOLDER = os.environ.get("REGISTERED_DATA", "/root/testdata/sf0.001")
there = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with the tables that the stages read."""
    rows = [r for r in documents() if r[0] is not None]
    bench = prose(990, 30)
    rows += [(400 + i, f"{prose(i + 300, 60)} vilegrub mudlump {prose(i, 5)}", "en", "s1", 0) for i in range(30)]
    rows += [(500, f"{prose(310, 50)} {bench}", "en", "s2", 0)]
    rows += [(600 + i, prose(i + 6000, 70), "en", "s1", 0) for i in range(120)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(400 + i, 1, 1) for i in range(30)] + [(600 + i, 1, 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def one_of_each(rows):
    """One row of each group of near duplicates, by comparing all pairs of rows; the lowest doc_id stays."""
    order = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    label = components([(i, r.text) for i, r in enumerate(order)], 5, 80)
    return [r for i, r in enumerate(order) if label[i] == i]


def test_near_duplicates_by_row(spark, tables):
    """Rows that share a doc_id, or have none, are documents of their own."""
    folder, _ = tables
    texts = [(1, prose(1, 80)), (1, prose(2, 80)), (2, prose(1, 80)), (None, prose(3, 80)), (None, prose(3, 80)), (None, prose(4, 80)), (3, prose(4, 80) + " end"), (3, prose(5, 9)), (3, prose(5, 9)), (4, None), (4, ""), (None, None)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in texts], clashing=True)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()
    assert got[0].asDict().keys() == set(docs.columns)
    wanted = [(1, prose(1, 80)), (1, prose(2, 80)), (None, prose(3, 80)), (3, prose(4, 80) + " end"), (3, prose(5, 9)), (4, None), (4, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(wanted, key=repr)
    assert {r.text for r in got} == {r.text for r in one_of_each(docs.collect())}


def test_near_duplicates_of_rows_with_ids_of_their_own(spark, tables):
    folder, _ = tables
    base = [prose(i, 80) for i in range(4)]
    texts = [*base, base[1], base[2] + " end", "", None, "one", "one"]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)], clashing=True)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in one_of_each(docs.collect()))


def test_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = f"{folder}/out-{name}"
        stage(spark, docs, folder).write.parquet(out)
        got[name] = before, after = docs.collect(), spark.read.parquet(out).collect()
        docs = spark.read.parquet(out)
        if name != "mixing":
            assert docs.columns == columns
    before, after = got["toxicity"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {400 + i for i in range(30)}
    before, after = got["line_dedup"]
    left = {r.doc_id: r.text for r in after}
    passages = [r for r in before if r.text and "\n" in r.text and len(words(r.text)) > 100]
    assert sum(prose(900, 90) in (left.get(r.doc_id) or "") for r in passages) == 1
    before, after = got["near_dedup"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in one_of_each(before))
    before, after = got["decontamination"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {500}
    before, after = got["mixing"]
    expected = {r.row.doc_id: r.taken for r in mixing.mixed(spark.createDataFrame(before, docs.select(*columns).schema)).collect() if r.taken}
    assert {r.doc_id: r.taken for r in after} == expected


def test_run_is_the_stages_in_order(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_and_odd_input(spark, tables, name, stage):
    folder, _ = tables
    assert stage(spark, frame(spark, []), folder).collect() == []
    df = frame(spark, clashing=True)
    got = stage(spark, df, folder)
    assert set(df.columns) <= set(got.columns)
    got.collect()


@there
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = check.sorted_rows(df.columns, df.collect())
    if name in ORACLE:
        con = duckdb.connect()
        for table in check.TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        result = con.execute(ORACLE[name])
        columns = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows == check.sorted_rows(columns, result.fetchall())
    elif name != "pipeline":
        assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
