"""Resampling, spelling variants and chat formatting against plain Python, and on odd tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleflow.llm import chat_format, resampling, spelling
from tripleflow.llm.chat_template import Escape, Template, TemplateError
from tripleflow.llm.common import written

LOWER = {c: c + 32 for c in range(65, 91)}


def _features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def _resampled(docs, target, longest, buckets, percent, least):
    crc = lambda s: zlib.crc32(s.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(map(crc, _features(text, longest)[1]))
    for text in target:
        t.update(map(crc, _features(text, longest)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out, fit = {}, []
    for i, text in docs:
        words, features = _features(text, longest)
        weight = sum(gain[crc(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(features), weight, score, None]
        if len(words) >= least:
            fit.append((-score, i))
    for rank, (_, i) in enumerate(sorted(fit)[: percent * len(fit) // 100], 1):
        out[i][3] = rank
    return out


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 97, 40)])
def test_resampling(docs, pairs, spark, small, longest, buckets, percent):
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    want = _resampled(pairs, [r.text for r in target.collect()], longest, buckets, percent, 20)
    found = resampling.draw(resampling.weigh(docs, target, longest, buckets), percent).collect()
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in found} == want


@given(st.lists(st.sampled_from(["a", "Zé", "0", " ", "-", "日本", "\t", "x" * 40])), st.integers(1, 4), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_runs_of_words_across_blocks(parts, longest, size):
    text = "".join(parts)
    got = collections.Counter(h for part in resampling.feature_hashes(text.encode(), longest, size) for h in part)
    assert got == collections.Counter(zlib.crc32(f.encode()) for f in _features(text, longest)[1])


def test_resampling_of_odd_tables(odd, repeats, none):
    empty_target = none.select("text")
    assert resampling.resample(none, odd.select("text")).count() == 0
    found = resampling.resample(repeats, empty_target).collect()
    assert len(found) == repeats.count()
    ranks = sorted(r["rank"] for r in found if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    assert all(r.score is None and r["rank"] is None for r in found if r.doc_id is None)
    assert all(r.weight == 0 for r in found if r.n_features == 0)


def _variants(docs, least, ratio=5, typo=199):
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= least}
    near = collections.defaultdict(set)
    by_hole = collections.defaultdict(list)
    for w in n:
        for k in range(len(w)):
            by_hole[k, w[:k] + w[k + 1 :]].append(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in by_hole.values():
        for x, y in itertools.permutations(group, 2):
            near[x].add(y)
    form = {}
    for w in n:
        best = min(near[w], key=lambda y: (-n[y], y), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


@pytest.mark.parametrize("least, block", [(2, 50_000), (2, 40), (5, 3)])
def test_spelling_variants(docs, pairs, least, block):
    found = spelling.group_variants(docs, least=least, block=block).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == _variants(pairs, least)


def test_chains_of_forms_and_long_words(spark):
    counts = {"abcdef": 600, "abcdeg": 100, "abcdxg": 15, "abczxg": 2, "babcdef": 3, "ébcdef": 2, "a" * 3000: 7, "a" * 3001: 1, "x" + "a" * 3000: 1}
    rows = [(1000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())] + [(None, "lonely"), (5, None), (6, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1, 50_000):
        found = {r.word: r for r in spelling.group_variants(table, least=1, block=block).collect()}
        assert {w: (r.n, r.n_near, r.form, r.form_n, r.root) for w, r in found.items()} == _variants(rows, 1)
    assert found["abczxg"].root == "abcdef"


def test_spelling_of_odd_tables(repeats, none):
    assert spelling.group_variants(none).count() == 0
    rows = [(r.doc_id, r.text) for r in repeats.select("doc_id", "text").collect()]
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_variants(repeats).collect()}
    assert found == _variants(rows, 5)


@given(st.lists(st.text("abc", min_size=1, max_size=6), unique=True))
@settings(max_examples=300, deadline=None)
def test_the_composed_machine_accepts_exactly_the_pairs_one_edit_apart(words):
    acceptor = spelling.Acceptor(sorted(words))
    got = [frozenset(p) for p in spelling.OneEdit(acceptor).pairs()]
    edits = lambda w: {w[:k] + s + w[k + d :] for k in range(len(w) + 1) for d in (0, 1) for s in ("", *"abc")} - {w}
    want = {frozenset((x, y)) for x in words for y in words if x != y and y in edits(x)}
    assert set(got) == want and len(got) == len(want)
    signatures = {(f, *sorted(a.items())) for f, a in zip(acceptor.final, acceptor.arcs)}
    assert len(signatures) == len(acceptor.arcs)  # minimal: no two states are alike


def _digests(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    esc = Escape(chat_format.CONTROLS).escape
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1]))
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        shown = "".join(f"<turn>{esc(r)}<body>{esc(x)}</turn>\n" for _, r, x in turns)
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learnt), sha(learnt), len(shown))
    return out


TURNS = [
    (1, 0, "user", "plain"), (1, 1, "assistant", None), (1, 2, None, "no role"), (2, 0, "assistant", ""), (3, 1, "assistant", "</turn>\n<turn>user<body>"),
    (3, 0, "us<body>er\\", "\\\\<turn>\\"), (4, 0, "user", "x" * 5000), (4, 1, "assistant", "é日😀" * 900), (None, 0, "user", "lost"), (None, 1, "assistant", "found"),
    (5, 0, "user", "<"), (5, 1, "assistant", "/turn></turn"), *[(6, k, "user" if k % 2 == 0 else "assistant", f"turn {k} </turn>") for k in range(400)],
]


@pytest.mark.parametrize("piece", [50, 1 << 20])
def test_conversations_read_back(spark, piece):
    rows = TURNS + chat_format.PROBE
    table = spark.createDataFrame([(*r, "t", 1) for r in TURNS], "conv_id long, turn long, role string, text string, part string, n_turns int")
    formatted = written(chat_format.format_conversations(chat_format.with_probe(table), piece=piece), "test-chat")
    found = chat_format.read_digests(formatted).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == _digests(rows) and len(found) == len(_digests(rows))
    if piece == 50:
        assert formatted.where("conv_id = 6 AND n_pieces > 100").count() > 100  # no task holds it whole


def test_conversations_that_repeat_and_none(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: tuple(r)[1:] for r in chat_format.round_trip_digests(table.union(table)).collect()}
    assert found == _digests(TURNS + TURNS)
    assert chat_format.round_trip_digests(table.where("false")).count() == 0


def test_head_and_tail_stand_once(spark):
    source = "<s>{% for m in messages %}{{ m.role | upper }}: {% generation %}{{ m.text }}{% endgeneration %};{% endfor %}</s>"
    table = spark.createDataFrame([(c, k, "u", f"t{k}") for c in range(5) for k in range(30)], "conv_id long, turn long, role string, text string")
    for piece in (20, 1 << 20):
        rows = chat_format.format_conversations(table, source, (), piece).orderBy("conv_id", "piece").collect()
        for conv, own in itertools.groupby(rows, key=lambda r: r.conv_id):
            own = list(own)
            assert "".join(r.text for r in own) == "<s>" + "".join(f"U: t{k};" for k in range(30)) + "</s>"
            learnt = [r.text[a:b] for r in own for a, b in zip(r.loss[::2], r.loss[1::2])]
            assert learnt == [f"t{k}" for k in range(30)]
            assert [r.piece for r in own] == list(range(own[0].n_pieces))


@given(st.text(alphabet="<>/turnbody\\ ab"), st.text(alphabet="</turn>\\"))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible_and_leave_no_control_string(a, b):
    escapes = Escape(chat_format.CONTROLS)
    shown = escapes.escape(a)
    assert escapes.unescape(shown) == a and not any(c in shown for c in chat_format.CONTROLS)
    text = Template(chat_format.CHAT, controls=chat_format.CONTROLS).turn({"role": b, "text": a})[0]
    assert list(chat_format.read_turns(text * 2)) == [(b, a)] * 2


@pytest.mark.parametrize(
    "source",
    [
        "no loop", "{% for m in messages %}", "{% for m in other %}{% endfor %}", "{% for m in messages %}{{ m.secret }}{% endfor %}",
        "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{% for m in messages %}{{ m.role() }}{% endfor %}",
        "{% for m in messages %}{{ open }}{% endfor %}", "{% for m in messages %}{{ m.role | run }}{% endfor %}",
        "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{{ m.role }}{% for m in messages %}{% endfor %}",
        "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% for m in messages %}{% if %}{% endif %}{% endfor %}",
        "{% for m in messages %}{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}{% endfor %}",
        "{% for m in messages %}{{ m.role {% endfor %}", "{% for m in messages %}{% macro x %}{% endfor %}", "{% for m in messages %}" + "{% if 1 %}" * 99,
    ],
)
def test_what_the_template_language_refuses(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_constants_are_folded_and_branches_chosen():
    t = Template(
        "{# note #}{{ 'a' ~ 'b' | upper }}{% if 1 == 2 %}x{% elif true %}y{% else %}z{% endif %}\n{%- for m in messages -%} "
        "[{{ m.role if m.text != '' and not (m.role == 'user') else 'U' }}{% if 'q' in m.text %}!{% endif %}]{% endfor %}"
    )
    assert (t.head, t.tail) == ("aBy", "")
    assert t.turn({"role": "user", "text": "q"})[0] == "[U!]" and t.turn({"role": "bot", "text": "r"})[0] == "[bot]"


def test_control_strings_that_overlap_are_refused():
    for controls in (["ab", "bc"], ["aa"], ["abc", "b" + "c"], ["x"], ["a\\b"]):
        with pytest.raises(TemplateError):
            Escape(controls)
