"""Of each component exactly one row stays, also where ids repeat; what is written goes again."""

import os

from pyspark.sql import functions as F

from pgq.llm import common as C
from pgq.llm import simhash

A = "one two three four five six seven eight nine ten eleven twelve"
B = "the quick brown fox jumps over a lazy dog and runs away from here"
D = "entirely other words that nobody else in this table has ever used"


def test_one_row_of_each_component_stays(spark):
    rows = [(1, A, "x"), (2, A, "y"), (2, B, "z"), (2, B, "w"), (3, D, "v"), (3, D, "v"), (3, D, "v"), (None, A, "n"), (4, A.upper(), "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    got = simhash.stage(spark, docs, "").collect()
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got)
    assert kept == [(-1, A), (1, A), (2, B), (3, D)]  # B of id 2 has no copy elsewhere: a smaller id's copy of A takes nothing from it
    fps = {r.doc_id: (r.fp, r.component_id) for r in simhash.components(docs).where("doc_id in (1, 4)").collect()}
    assert fps[1] == fps[4]


def test_a_third_of_rows_of_one_id(spark):
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 1000).alias("doc_id"), F.when(F.col("id") % 3 == 0, A).otherwise(F.concat_ws(" ", F.col("id"), F.md5(F.col("id").cast("string")), F.sha1(F.col("id").cast("string")))).alias("text"))
    got = simhash.stage(spark, docs, "")
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert ids.count(7) == 1 and len(ids) == len(set(ids))


def test_written_folders_and_tables_can_be_removed(spark):
    mark = C.made()
    kept = C.materialize(spark.range(5))
    blocks = C.blocks_of(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    (path, _), (other, table) = C._MADE[mark:]
    assert blocks.count() == 1 and os.path.isdir(other) and spark.catalog.tableExists(table)
    C.remove_since(spark, mark, kept)
    assert kept.count() == 5 and os.path.isdir(path) and not os.path.isdir(other) and not spark.catalog.tableExists(table)
    C.remove_since(spark, mark)
    assert not os.path.isdir(path)
