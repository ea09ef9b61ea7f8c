"""What steps leave on disk, and what stands between them: shuffles made once, files not copied in the heap."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from tripleflow.llm import line_dedup, token_files
from tripleflow.llm.common import CLEANUP, settings, written
from tripleflow.llm.queries import END_ID, tokenizer_file


def _plan(frame, capsys):
    frame.explain()
    return capsys.readouterr().out


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, set_to = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    frame = spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 900).alias("k")).count()
    table = written(frame, "left-over")
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert table.count() == 900 and table.agg(F.sum("count")).first()[0] == 5000
    assert spark.conf.get(CLEANUP, None) == set_to


def test_settings_are_put_back_after_an_error(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.some.name.nobody.set"]
    old = [spark.conf.get(n, None) for n in names]
    with pytest.raises(KeyError), settings(spark, dict.fromkeys(names, "3")):
        assert [spark.conf.get(n) for n in names] == ["3", "3"]
        raise KeyError
    assert [spark.conf.get(n, None) for n in names] == old


def test_tokens_of_lines_are_shuffled_once(spark, tmp_path, capsys):
    """Of what a table of classes gives, as `_possible` reads it."""
    spark.range(60).selectExpr("id % 5 AS doc_id", "CAST(id AS int) AS line", "20 AS n", "array(id, id DIV 2, 7) AS prefix").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").select(
        F.explode_outer("prefix").alias("t"), "doc_id", "line", F.expr(line_dedup._NEEDED).alias("needed")
    )
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        plan = _plan(line_dedup._met_enough(rows), capsys)
    assert "ReusedExchange" in plan and plan.count("Scan parquet") == 1


def test_lines_met_often_enough_stay(spark):
    rows = spark.createDataFrame(
        [(1, 5, 0, 2), (2, 5, 0, 2), (1, 6, 0, 2), (2, 6, 1, 1), (9, 6, 1, 1), (3, 7, 0, 1), (1, 8, 0, 1), (4, 8, 0, 3), (1, 9, 3, None)],
        "t long, doc_id long, line int, needed int",
    )
    found = {(r.doc_id, r.line): (r.met, r.needed) for r in line_dedup._met_enough(rows).collect()}
    assert found == {(5, 0): (2, 2), (6, 1): (1, 1), (8, 0): (1, 1)}


def test_file_contents_go_to_python_without_a_copy_in_the_plan(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(i, f"text {i}\nand 2 more") for i in range(40)], "doc_id long, text string")
    token_files.write_token_files(docs, tokenizer_file("byte_bpe_50k.json"), END_ID, f"{tmp_path}/records", bytes_per_file=200)
    read = token_files.read_token_files(spark, f"{tmp_path}/records")
    above_scan = _plan(read, capsys).split("Scan binaryFile")[0]
    assert "MapInArrow" in above_scan and "Filter" not in above_scan and "Project" not in above_scan
    found = read.select("doc_id", "file").collect()
    assert sorted(r.doc_id for r in found) == list(range(40)) and len({r.file for r in found}) > 5
    assert all(r.file.startswith("part-") for r in found)


def test_a_file_of_bytes_that_are_no_text(spark, tmp_path):
    """The text type that carries a file's content changes none of its bytes."""
    texts = ["".join(map(chr, range(k, k + 40))) for k in range(32, 20_000, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_token_files(docs, tokenizer_file("byte_bpe_50k.json"), END_ID, f"{tmp_path}/records", bytes_per_file=3000)
    contents = [open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/records/part-*"))]
    assert any(b"\xff" in c or b"\xc0" in c for c in contents)
    assert sum(1 for c in contents for _ in token_files.parse(c)) == len(texts)
