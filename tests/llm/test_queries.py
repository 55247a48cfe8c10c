"""The queries and the pipeline over a whole small data set."""

import zlib

import numpy as np
import pytest
from helpers import DATA, connect, same_rows

import corpus_pipeline
from echofold.llm import queries, shingle_join, suffix_dedup, vantage_search
from echofold.llm._common import table, written

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect("sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_has_the_rows_of_its_sql(spark, con, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], con)


@pytest.mark.parametrize("n", [1, 3, 4, 8, 9, 10])
def test_one_row_for_each_document(spark, con, n):
    name = next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))
    got = [r["doc_id"] for r in queries.QUERIES[name](spark, SF).collect()]
    assert sorted(got) == [r[0] for r in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]


def test_recall_over_the_test_vectors(spark):
    rows = table(spark, SF, "embeddings").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in vantage_search.query(spark, SF).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = np.cumsum(x * x[k], axis=1)[:, -1]
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if i != k][:20]
        hits.append(len(set(best) & set(got[int(ids[k])])) / 20)
        assert all(got[int(ids[k])][int(ids[i])] == s[i] for i in range(len(ids)) if int(ids[i]) in got[int(ids[k])])
    assert np.mean(hits) == 1


def test_language_of_held_out_documents(spark, con):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_language_id"](spark, f"{DATA}/sf0.01").collect()}
    rows = connect("sf0.01").execute("SELECT doc_id, lang FROM documents").fetchall()
    held = [(i, x) for i, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == x and got[i]["held_out"] for i, x in held]) > 0.97


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), "test-stage")
        rows = before.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            assert docs.count() == len(rows)
        if name == "near_duplicates":
            best = {r["doc_id"]: r["component_id"] for r in shingle_join.components(before).collect()}
            assert {r["doc_id"] for r in docs.collect()} == {i for i, c in best.items() if i == c}
        if name == "repeats":
            sizes = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in suffix_dedup.removals(before).collect()}
            assert all(len(r["text"].encode()) <= sizes[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in docs.collect()) and docs.count() == len(rows)
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in rows}
