"""Every operator against brute force on the small table with odd rows, and on odd tables."""

import collections
import hashlib
import os
import re
import zlib
from urllib.parse import unquote

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import PASSAGE
from tripleflow.llm import exact_dedup, html_extract, line_dedup, packing, quality, sentencepiece_codec
from tripleflow.llm import simhash, suffix_dedup, token_files, toxicity
from tripleflow.llm.common import written
from tripleflow.llm.queries import END_ID, tokenizer_file

sha = lambda data: hashlib.sha256(data).hexdigest()
by_id = lambda frame: {r.doc_id: r for r in frame.collect()}

PER_ROW = {
    "op1": lambda d: sentencepiece_codec.round_trip_digests(d, tokenizer_file("piece_bpe_32k.model")),
    "op2": exact_dedup.dedup,
    "op4": quality.judge,
    "op7": simhash.near_duplicates,
    "op8": line_dedup.line_report,
    "op9": suffix_dedup.removal_digests,
    "op10": lambda d: token_files.token_file_round_trip(d, tokenizer_file("byte_bpe_50k.json"), END_ID),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_repeated_rows_rows_without_id_and_empty_tables(name, repeats, none):
    assert PER_ROW[name](repeats).count() == repeats.count()
    assert PER_ROW[name](none).count() == 0


def test_packing_of_repeated_rows_and_empty_tables(repeats, none):
    pack = lambda d: packing.pieces_with_digest(d, tokenizer_file("word_bpe_49k.json"), END_ID)
    pieces = pack(repeats).collect()
    assert sum(p.start == 0 for p in pieces) == repeats.count()
    assert pack(none).count() == 0


def test_sentencepiece_equals_the_library(docs, pairs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = by_id(PER_ROW["op1"](docs))
    assert len(found) == len(pairs)
    for i, text in pairs:
        ids, row = model.encode(text), found[i]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode())), i
        assert row.decoded_sha256 == sha(model.decode(ids).encode()), i


def test_sentencepiece_ids_decode_to_texts(odd):
    model = tokenizer_file("piece_bpe_32k.model")
    encoded = sentencepiece_codec.encode_documents(odd, model)
    assert encoded.count() == odd.count() == sentencepiece_codec.decode_documents(encoded, model).count()


def test_exact_dedup_keeps_the_longest_original(docs, pairs):
    groups = collections.defaultdict(list)
    for i, text in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), i))
    found = by_id(exact_dedup.dedup(docs))
    for i, text in pairs:
        key = re.sub(r"[\x20\x09-\x0D]", "", text)
        keep = min(groups[key])[1]
        row = found[i]
        assert (row.keep_id, row.group_size, row.kept, row.text_sha256) == (keep, len(groups[key]), keep == i, sha(key.encode()))


def test_exact_dedup_against_a_history(docs):
    new, old = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0")
    texts = {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in old.collect()}
    found = by_id(exact_dedup.dedup(new, old))
    for r in new.collect():
        if re.sub(r"[\x20\x09-\x0D]", "", r.text or "") in texts:
            assert not found[r.doc_id].kept and found[r.doc_id].keep_id % 2 == 1


@pytest.mark.parametrize("bound", [None, -10_000, 0, 77, 10_000])
def test_any_part_of_a_table_may_be_its_history(docs, bound):
    want = {tuple(r) for r in exact_dedup.dedup(docs).collect()}
    history = docs.where("false") if bound is None else docs.where(F.col("doc_id") < bound)
    new = docs if bound is None else docs.where(F.col("doc_id") >= bound)
    found = exact_dedup.merged(exact_dedup.keyed(history), exact_dedup.keyed(new))
    assert {tuple(r) for r in found.collect()} == want


def test_members_and_nonmembers_are_told_apart(docs):
    old = exact_dedup.winners(exact_dedup.keyed(docs.where("doc_id % 2 = 0")))
    new = exact_dedup.winners(exact_dedup.keyed(docs.where("doc_id % 2 <> 0")))
    known = {bytes(r.digest) for r in old.collect()}
    found = exact_dedup.look_up(new, exact_dedup.build_index(old, 3), 3).collect()
    assert {bytes(r.digest) for r in found if r.member} == {bytes(r.digest) for r in new.collect()} & known
    assert any(r.member for r in found) and not all(r.member for r in found)


def test_quality_counts(docs, pairs):
    found = by_id(quality.judge(docs))
    for i, text in pairs:
        row, want = found[i], brute.quality_counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, i
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (row.kept and row.base_failed)


def test_simhash_links(docs, pairs):
    prints = {i: brute.fingerprint(text) for i, text in pairs}
    roots = brute.components(prints)
    found = by_id(simhash.near_duplicates(docs))
    for i in prints:
        assert (found[i].fingerprint, found[i].component_id) == (f"{prints[i]:016x}", roots[i])


def test_golay_keys_meet_at_every_distance_up_to_the_limit():
    rng = np.random.default_rng(3)
    golay = simhash.Golay()
    base = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    far = base.copy()
    for k in range(len(far)):
        for bit in rng.choice(64, k % 5, replace=False):
            far[k] ^= np.uint64(1) << np.uint64(bit)
    (i, a), (j, b) = simhash.keys_of(base, golay), simhash.keys_of(far, golay)
    first, second = collections.defaultdict(set), collections.defaultdict(set)
    for n, key in zip(i.tolist(), a.tolist()):
        first[n].add(key)
    for n, key in zip(j.tolist(), b.tolist()):
        second[n].add(key)
    assert all(first[n] & second[n] for n in range(len(base)))


def test_repeated_lines(docs, pairs):
    want = brute.repeated_lines(pairs)
    found = by_id(line_dedup.line_report(docs))
    whole = by_id(line_dedup.dedup_lines(docs))
    for i, text in pairs:
        lines = text.split("\n")
        assert (found[i].n_lines, found[i].n_removed) == (len(lines), len(want[i]))
        assert found[i].removed == ",".join(map(str, want[i]))
        assert whole[i].text == "\n".join(s for k, s in enumerate(lines) if k not in set(want[i]))


def test_lines_at_the_edge_of_similarity(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 13 + i] + [f"z{i}"] * (i % 3))) for i in range(40)]
    want = brute.repeated_lines(rows)
    found = by_id(line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.n_removed for i, r in found.items()} == {i: len(w) for i, w in want.items()}


def test_repeated_strings(docs, pairs):
    want = brute.removed_bytes(pairs)
    found = by_id(suffix_dedup.removal_digests(docs))
    for i, text in pairs:
        data, gone = text.encode(), want[i]
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        row = found[i]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(data), int(gone.sum()), spans, sha(kept)), i


def test_strings_that_share_a_fingerprint(monkeypatch):
    """Ranks do not rest on fingerprints: their bytes decide where these meet."""
    data = np.frombuffer(("ab cd ef gh " * 40 + "ab cd eg gh " * 40).encode(), np.uint8)
    places = np.arange(0, len(data) - suffix_dedup.LENGTH, 7)
    order = np.arange(len(places))[::-1].copy()
    strings = [data[p : p + suffix_dedup.LENGTH].tobytes() for p in places]
    least = {}
    for s, o in zip(strings, order):
        least[s] = min(o, least.get(s, o))
    want = [o > least[s] for s, o in zip(strings, order)]
    at = suffix_dedup.Rolling.at
    monkeypatch.setattr(suffix_dedup.Rolling, "at", lambda self, starts, lengths: at(self, starts, lengths) & np.uint64(7))
    assert suffix_dedup.repeats_in_block(data, places, order).tolist() == want and 0 < sum(want) < len(want)


def test_crowded_buckets_of_strings(spark, monkeypatch):
    """Whole runs are stored, and of their strings those whose fingerprint meets another's are compared by bytes."""
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", 3)
    stored = []
    monkeypatch.setattr(suffix_dedup, "written", lambda f, purpose: stored.append((purpose, t := written(f, purpose))) or t)
    monkeypatch.setattr(suffix_dedup, "discard", lambda table: None)
    shared = "the quick brown fox jumps over the lazy dog while seven wizards watch from a distant hill"
    rows = [(i, f"{chr(97 + i) * 40}{shared}{'yz'[i % 2] * (12 + i % 5)}{chr(97 + i) * 60}") for i in range(20)]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string")
    want = brute.removed_bytes(rows)
    found = by_id(suffix_dedup.removal_digests(docs))
    assert {i: r.n_removed for i, r in found.items()} == {i: int(want[i].sum()) for i, _ in rows}
    assert sum(int(w.sum()) for w in want.values()) > 0
    crowded = dict(stored)["run-bytes"].where("hot").selectExpr("sn % 256 AS n", "length(raw) AS k").collect()
    assert len(crowded) > 3 and max(r.n for r in crowded) > 1 and all(r.k == r.n + suffix_dedup.LENGTH - 1 for r in crowded)


def test_repeated_strings_leave_one_table_and_cut_texts_once(spark, monkeypatch):
    plans, files = {}, {}

    def kept(frame, purpose):
        plans[purpose] = frame._jdf.queryExecution().optimizedPlan().toString()
        table = written(frame, purpose)
        files[purpose] = [unquote(f.removeprefix("file://")) for f in table.inputFiles()]
        return table

    monkeypatch.setattr(suffix_dedup, "written", kept)
    rows = [(i, f"{PASSAGE} and {PASSAGE} {i // 2}") for i in range(12)]
    found = suffix_dedup.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert plans["shared-runs"].count("MapInArrow") == 1
    assert {p for p, some in files.items() if any(map(os.path.exists, some))} == {"repeats"}
    assert all(files.values()) and len(files) == 4 and found.count() > 0


def test_difference_cover():
    for period in (7, 32, 50):
        places = suffix_dedup.cover(period)
        assert {(a - b) % period for a in places for b in places} == set(range(period))


def test_packing(docs, pairs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in packing.pieces_with_digest(docs, tokenizer_file("word_bpe_49k.json"), END_ID).collect():
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for i, text in pairs:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [END_ID], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            part = ids[at : at + p.length]
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += p.length
        assert at == len(ids)
    sizes = []
    for held in sequences.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        sizes.append(at)
    assert max(sizes) <= 4096 and sum(s < 4096 for s in sizes) <= 13


def test_token_files(docs, pairs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found, at = by_id(PER_ROW["op10"](docs)), 0
    for i, text in pairs:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [END_ID], "<u4")
        row = found[i]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), i
        at += len(ids)


@pytest.mark.parametrize("file, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_strings_of_special_tokens_are_what_the_library_makes_of_them(file, kind):
    from tokenizers import Tokenizer

    from tripleflow.llm.wordmemo import WordMemo

    tokenizer, memo = Tokenizer.from_file(public_tokenizers.path(file)), WordMemo(public_tokenizers.path(file), kind)
    texts = ["plain", "x <|endoftext|> y", "<|startoftext|>", "a<|ENDOFTEXT|>b", "a < b | c > d <| e |>", "<|endoftext", "", "<|endoftext|>" * 3]
    for text, ids in zip(texts, memo.ids(texts)):
        assert np.frombuffer(ids, memo.type).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_damaged_records_are_noticed():
    record = token_files.frame(5, np.arange(9, dtype="<u2").tobytes(), 2)
    good = record + record + b"\n"
    assert [(r[0], r[1]) for r in token_files.parse(good)] == [(5, 0), (5, len(record))]
    for place in range(len(good)):
        bad = bytearray(good)
        bad[place] ^= 1
        with pytest.raises(ValueError):
            list(token_files.parse(bytes(bad)))
        with pytest.raises(ValueError):
            list(token_files.parse(good[: place]))


def test_files_are_bounded_by_bytes_and_read_in_any_order(spark, docs, pairs, tmp_path):
    import os

    folder, index = f"{tmp_path}/records", f"{tmp_path}/index"
    token_files.write_token_files(docs, tokenizer_file("byte_bpe_50k.json"), END_ID, folder, bytes_per_file=50_000)
    token_files.write_index(spark, folder, index)
    places = spark.read.parquet(index)
    longest = places.agg(F.max("record_bytes")).first()[0]
    sizes = [os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part")]
    assert max(sizes) <= 50_000 + longest and len([s for s in sizes if s]) >= sum(sizes) // (50_000 + longest)
    shuffled = places.repartition(3).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7))).persist()
    wanted = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in shuffled.collect()]
    read = token_files.read_at(shuffled, folder).collect()
    assert [(r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in read] == wanted
    assert sorted(d for d, _, _ in wanted) == [i for i, _ in pairs] and wanted != sorted(wanted)
    at = 0
    for row in sorted(places.collect(), key=lambda r: r.doc_id):
        assert row.start == at
        at += row.n_tokens


def test_many_rows_without_an_id_are_spread(spark, tmp_path):
    rows = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same text' AS text")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        token_files.write_token_files(rows, tokenizer_file("byte_bpe_50k.json"), END_ID, f"{tmp_path}/records")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    read = token_files.read_token_files(spark, f"{tmp_path}/records").groupBy("file").count().collect()
    assert sum(r["count"] for r in read) == 2000 and max(r["count"] for r in read) < 500


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    caught, missed = counts.get((1, 1), 0), counts.get((1, 0), 0)
    wrong, right = counts.get((0, 1), 0), counts.get((0, 0), 0)
    assert caught >= 0.6 * (caught + missed) and wrong <= 0.02 * (wrong + right)
    want = {i for i, in scored.select("doc_id").collect() if zlib.crc32(str(i).encode()) % 3 != 1}
    assert not want


def test_toxicity_of_odd_rows(spark, odd, repeats, none):
    labels = spark.createDataFrame([(-5, 1), (-2, 0), (None, 1)], "doc_id long, toxic int")
    for table in (odd, repeats, none):
        scored = toxicity.toxic_documents(table, labels)
        assert scored.count() == table.count()
        assert scored.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> CAST(score >= 0.7 AS INT)").count() == 0


def test_noisy_or_combines_sentences():
    model = toxicity.Model({"bad": 3.0, "fine": -3.0}, -4.0)
    one, two = model.document("bad."), model.document("bad. bad.")
    assert 0 <= model.document("") < one < two < 1
    assert two == pytest.approx(1 - (1 - one) ** 2, abs=0.02)


PAGE = """<html><head><title>T</title><style>p {}</style><script>var a = "<p>no</p>";</script></head><body>
<header><p>Site name, slogan, and more</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="content"><h1>A title</h1><p>First paragraph, with commas, &amp; a   reference,
 long enough to count as one of the article's own.</p><p>Second <b>paragraph</b>, with &#233;, and more text, again, and again.</p></div>
<div class="sidebar"><p><a href="/x">Read this too</a></p></div><div class="comments"><p>I, too, have a comment, a long one.</p></div>
<form><p>Sign up</p></form><footer><p>Terms, conditions</p></footer></body></html>"""


def test_html_extraction(spark, small):
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (3, "u", "", ""), (4, "u", "<p>unclosed <b>one<p>two", ""), (4, "u", "plain", "")]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(found) == len(rows)
    text = next(r.text for r in found if r.page_id == 1)
    assert text == (
        "A title\nFirst paragraph, with commas, & a reference, long enough to count as one of the article's own."
        "\nSecond paragraph, with é, and more text, again, and again."
    )
    assert {r.page_id: (r.text, r.n_chars) for r in found if r.page_id in (2, 3)} == {2: ("", 0), 3: ("", 0)}
    pages = spark.read.parquet(f"{small}/pages.parquet")
    all_pages = html_extract.extract(pages)
    assert all_pages.count() == pages.count() and all_pages.where("n_chars <> char_length(text)").count() == 0


def test_sql_agrees(spark, small):
    from tripleflow.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    for name, sql in SQL.items():
        cursor = con.execute(sql)
        columns = [d[0] for d in cursor.description]
        want = collections.Counter(map(tuple, cursor.fetchall()))
        assert collections.Counter(map(tuple, QUERIES[name](spark, small).select(*columns).collect())) == want, name
