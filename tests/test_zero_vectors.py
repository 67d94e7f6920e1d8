"""A chunk whose hashed words cancel out has a cosine of zero, in the query and in its SQL."""

import os

import duckdb

import __spark_entry__ as entry
from evidex.operators.hooks import _place


def cancelling() -> str:
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    return next(f"{x} {y}" for x in words for y in words if _place(x, 64) == (_place(y, 64)[0], -_place(y, 64)[1]))


def test_retrieve_basic_with_a_zero_vector_equals_its_sql(spark, sf, tmp_path):
    con, folder = duckdb.connect(), str(tmp_path)
    con.execute(f"copy (select * from '{sf}/documents.parquet' union all select 900001, '{cancelling()}', 'en', 'x', 5) to '{folder}/documents.parquet'")
    con.execute(f"copy (select * from '{sf}/benchmark.parquet') to '{folder}/benchmark.parquet'")
    for name in os.listdir(folder):
        con.execute(f"create view {name[:-8]} as select * from '{folder}/{name}'")
    want = con.execute(f"select qid, chunk_id, rank, score from ({entry.oracle_sql()['retrieve_basic']})").fetchall()
    got = entry.queries()["retrieve_basic"](spark, folder).select("qid", "chunk_id", "rank", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
