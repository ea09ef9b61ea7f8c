import pytest
from pyspark.errors import PySparkException

from tripleflow.sources.lines import clean_lines, read_lines, read_log
from tripleflow.sources.triples import (
    kv_triples,
    parse_kv,
    parse_triples,
    parse_words,
    parse_words_int,
    stream_triples,
    to_lines,
    triple_universe,
    validate_triples,
)
from tripleflow.sources.workdir import fresh_folder
from tripleflow.streaming import run_to_end, stream_collect


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_read_lines_trims_control_characters(spark, tmp_path, rows):
    (tmp_path / "in.txt").write_text("\t A_foo_0 \x01\n\n   \nB_bar_1\r\n\x1fC_foo_2")
    assert rows(read_lines(spark, str(tmp_path))) == [("A_foo_0",), ("B_bar_1",), ("C_foo_2",)]


def test_clean_lines_keeps_other_columns(spark, rows):
    df = spark.createDataFrame([(1, " a \r\n\nb\rc\x00")], "id int, text string")
    assert rows(clean_lines(df, "text")) == [(1, "a"), (1, "b"), (1, "c")]


def test_parse_ignores_empty_parts(spark, rows):
    df = lines(spark, "_A__foo_1_", "B_bar_2")
    assert rows(parse_triples(df)) == [("A", "foo", "1"), ("B", "bar", "2")]


@pytest.mark.parametrize("bad", ["A_foo", "A_foo_1_x", "", "___", None])
def test_strict_parse_fails_on_anything_else(spark, bad):
    with pytest.raises(PySparkException, match="not a triple"):
        parse_triples(lines(spark, "A_foo_1", bad)).collect()


def test_quarantine_separates(spark, rows):
    good, bad = parse_triples(lines(spark, "A_foo_1", "A_foo", "a_b_c_d", None), mode="quarantine")
    assert rows(good) == [("A", "foo", "1")]
    assert rows(bad) == [("A_foo",), (None,), ("a_b_c_d",)]


def test_other_delimiters_are_characters_not_patterns(spark, rows):
    assert rows(parse_triples(lines(spark, "A.|foo|.1"), delim=".|")) == [("A", "foo", "1")]
    assert rows(parse_triples(lines(spark, "A^foo^]1"), delim="^]")) == [("A", "foo", "1")]


def test_trim_takes_every_low_character_and_no_other(spark):
    df = spark.sql("SELECT id, concat(char(id), ' a', char(id), 'b ', char(id)) AS line FROM range(1, 160)")
    got = {r["id"]: r["line"] for r in clean_lines(df.where("id NOT IN (10, 13)")).collect()}
    for i, line in got.items():
        c = chr(i)
        assert line == (f"a{c}b" if i <= 32 else f"{c} a{c}b {c}"), i


def test_validate_counts(spark, rows):
    df = lines(spark, "A_foo_1", "A_foo", "x", None)
    assert rows(validate_triples(df)) == [(False, 3), (True, 1)]


def test_words(spark, rows):
    df = lines(spark, "A foo B", "A bar C", "D foo E rest")
    assert rows(parse_words(df, "foo")) == [("A", "B"), ("D", "E")]
    short = lines(spark, "A foo B", "A bar", None)
    with pytest.raises(PySparkException, match="fewer than three"):
        parse_words(short, "foo").collect()
    assert rows(parse_words(short, "foo", mode="skip")) == [("A", "B")]


def test_words_with_integer(spark, rows):
    assert rows(parse_words_int(lines(spark, "A 1", "B 2", "C 1"), 1)) == [("A",), ("C",)]
    with pytest.raises(PySparkException, match="not an integer"):
        parse_words_int(lines(spark, "A 1", "B x"), 1).collect()
    assert rows(parse_words_int(lines(spark, "A 1", "B x", "C"), 1, mode="skip")) == [("A",)]


def test_universe_size_and_round_trip(spark, rows):
    universe = triple_universe(spark, 10)
    assert universe.count() == universe.distinct().count() == 60
    assert rows(parse_triples(to_lines(universe))) == rows(universe)


def test_kv_round_trip(spark, rows):
    kv = kv_triples(spark, 2)
    assert ("subj=a pred=foo obj=0",) in rows(kv)
    assert rows(parse_kv(kv), "subj", "pred", "obj")[:2] == [("a", "foo", "0"), ("a", "foo", "1")]
    assert kv.count() == 8


def test_stream_triples_from_text_files(spark, tmp_path, rows):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text(f"A_foo_{i}\nB_bar_{i}\n")
    triples = stream_triples(spark, str(source), maxFilesPerTrigger="1")
    folder = fresh_folder(spark, "t")
    run_to_end(stream_collect(triples, f"{folder}/rows", f"{folder}/checkpoint"))
    assert spark.read.parquet(f"{folder}/rows").count() == 6


def test_log_positions_follow_the_file_over_splits(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "run-1").write_text("\n".join(text) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        log = read_log(spark, str(tmp_path))
        assert log.rdd.getNumPartitions() > 4
        got = [r["line"] for r in sorted(log.collect(), key=lambda r: r["pos"])]
        assert got == text
        assert log.select("pos").distinct().count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
