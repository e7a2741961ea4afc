"""Alignment, packing and importance resampling against plain versions, and on hard input."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwell.llm import alignment, importance, packing, queries, tokens
from tests.harness import same
from tests.llm.test_llm import DOC, EDGE, SF, by_id, docs, docs_of, edge  # noqa: F401

HARD = [
    *EDGE, "▁ in it", "<|endoftext|> and <s> x", " ", "  two  spaces ", "a\n\n b \t c ", "漢字かな交じり文です。" * 300, "안녕하세요 세계 " * 40, "\U0001f469‍\U0001f469‍\U0001f467 é é  x y", "x" * 3000, "a b" + " " * 900 + "c",
    "def f(x):\n    return x  # note\n\n\n", "\x1c \x85 ﻿ z", "1234567890" * 200, "It's we'll I'd", "\t", "tab\tx\r\n y", "-" * 700 + " " + "=-" * 400,
]


@pytest.fixture(scope="module")
def hard(spark):
    return docs_of(spark, HARD).cache()


def libraries(special=False):
    t = tokenizers.Tokenizer.from_file(alignment.A_PATH)
    t.encode_special_tokens = not special
    return t, sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)


def plain_groups(text, t, s, a_bytes, b_bytes):
    """The groups of a text by sets of token ends, or None."""
    a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
    whole = (" " + text).encode()
    if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
        return None
    ends = [np.cumsum([len(of[i]) for i in ids]).tolist() for of, ids in ((a_bytes, a), (b_bytes, b))]
    out, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        x, y = i, j
        while i < len(a) and ends[0][i] <= e:
            i += 1
        while j < len(b) and ends[1][j] <= e:
            j += 1
        out.append((e, a[x:i], b[y:j]))
    return out


def plain_alignment(texts):
    t, s = libraries()
    own = alignment.aligner(alignment.read_bpe(alignment.A_PATH), alignment.read_model(alignment.B_PATH))
    found = [plain_groups(x or "", t, s, own.a.bytes, own.b.bytes) for x in texts]
    pairs = [collections.Counter((x, y) for _, a, b in g or [] for x in a for y in b) for g in found]
    held, most = collections.Counter(p for c in pairs for p in c), collections.Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    rows = []
    for g, c in zip(found, pairs, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, a, b in g or [])
        counts = [sum(len(x[k]) for x in g or []) for k in (1, 2)]
        rows.append((*counts, len(g or []), sum(c.values()), sum(n for p, n in c.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return rows, held, found


# 11


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_alignment(request, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    want, held, _ = plain_alignment([r.text for r in rows])
    got = alignment.linked(df, block=2000)  # many blocks
    have = collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.digest) for r in got.documents.collect())
    assert have == collections.Counter((r.doc_id, *w) for r, w in zip(rows, want, strict=True))
    assert {(r.a, r.b): r.documents for r in got.pairs.collect()} == held
    assert alignment.linked(df.limit(0)).documents.count() == 0


def test_spans(hard):
    _, _, found = plain_alignment(HARD)
    got = by_id(alignment.spans(hard))
    for i, g in enumerate(found):
        assert [(x.end, x.a, x.b) for x in got[i].groups] == (g or [])
        assert [x.start for x in got[i].groups] == [0, *[x.end for x in got[i].groups]][:-1]


def test_links_of_large_groups_are_counted_first():
    g = alignment.groups(np.array([1, 2, 3, 5, 9]), np.array([4, 5, 6, 9]))
    assert (g.n_a.tolist(), g.n_b.tolist(), g.end.tolist()) == ([4, 1], [2, 2], [5, 9])
    a, b = np.array([7, 7, 8, 7, 1]), np.array([3, 3, 4, 5])
    count = lambda at_once: collections.Counter((int(x), int(k)) for x, k, n in zip(*alignment.links(g, a, b, at_once), strict=True) for _ in range(n))
    assert count(1 << 20) == count(1) and sum(count(1).values()) == 4 * 2 + 1 * 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'sz09 .-\n\té漢▁ 　한", max_size=30), max_size=6))
def test_chunks_give_the_libraries_tokens(texts):
    t, s = libraries()
    own = alignment.aligner(alignment.read_bpe(alignment.A_PATH), alignment.read_model(alignment.B_PATH))
    for text, got in zip(texts, own.texts(texts), strict=True):
        want = plain_groups(text, t, s, own.a.bytes, own.b.bytes)
        assert (got is None) == (want is None) and (want is None or got[0].tolist() == [sum(len(x[1]) for x in want), sum(len(x[2]) for x in want), len(want)])
    enc = packing.encoder(tokens.read_bpe(packing.MODEL))
    assert [x.tolist() for x in enc.texts(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_byte_pairs_of_all_characters():
    """Each character among others: the faster library gives the tokenizer's ids, whatever Unicode version either knows."""
    t, _ = libraries()
    own = tokens.byte_bpe(tokens.read_bpe(packing.MODEL))
    texts = [f"a{c}1{c} {c}b" for c in map(chr, [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 5)])]
    assert [own.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_chunks_are_forgotten_and_come_back():
    own = packing.Encoder(tokens.byte_bpe(tokens.read_bpe(packing.MODEL)), most=5)
    t, _ = libraries()
    for _ in range(3):
        for text in ("one two three four five six seven", "two " + "y" * 40_000 + " z", "one two"):
            assert own.texts([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


# 12


def check_packing(rows, texts, capacity):
    """Pieces against the tokenizer, and sequences without gaps. Gives their number."""
    t, _ = libraries(special=True)
    left = collections.Counter()
    for doc_id, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            left[doc_id, k, x, y - x, zlib.crc32(ids[x:y].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == left
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    rows = packing.packed(df).collect()
    n = check_packing(rows, df.select("doc_id", "text").collect(), 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.01 + 1
    assert packing.packed(df.limit(0)).count() == 0


def test_packing_in_many_blocks(docs):  # noqa: F811
    """Blocks of few documents, a small capacity: what each leaves is packed again on the next level."""
    rows = packing.packed(docs, capacity=512, block=20).collect()
    n = check_packing(rows, docs.select("doc_id", "text").collect(), 512)
    bound = -(-sum(r.length for r in rows) // 512)
    assert n <= bound * 1.03 + 1, (n, bound)


def test_grouping_genetic_algorithm():
    draw = np.random.default_rng(5)
    size = draw.integers(180, 720, 150)
    start = []
    for _ in range(2):
        where = np.empty(len(size), np.int64)
        packing.best_fit(size, draw.permutation(len(size)), where, [], 2048)
        start.append(where)
    child = packing.crossover(size, *start, 2048, draw)
    for w in (child, packing.mutated(size, child, 2048, draw), *packing.evolved(size, start, 2048, 1)):
        fill = packing.filled(size, w)
        assert fill.max() <= 2048 and fill.min() > 0 and fill.sum() == size.sum()
    # whole bins of the second parent are in the child
    bins = lambda w: {frozenset(np.flatnonzero(w == b).tolist()) for b in range(w.max() + 1)}
    assert bins(child) & bins(start[1])
    best = packing.evolved(size, start, 2048, 1)[0]
    assert packing.fitness(size, best, 2048) >= max(packing.fitness(size, w, 2048) for w in start)
    # four bins of three that best fit decreasing packs into five
    tricky = np.array([7, 6, 3, 3, 2] * 4) * 100
    assert packing.fewest(tricky, 2100) == 4 and packing.fewest(np.array([1100] * 7), 2048) == 7
    assert len(packing.filled(tricky, packing.evolved(tricky, [], 2100, 3, children=200)[0])) == 4


def test_sequences(spark):
    df = docs_of(spark, ["one two three", None, "four " * 30, "five"])
    got = packing.sequences(df, capacity=16, block=4).collect()
    t, _ = libraries(special=True)
    assert all(len(r.ids) <= 16 for r in got)
    whole = collections.Counter(i for r in got for i in r.ids)
    assert whole == collections.Counter(i for r in df.collect() for i in [*t.encode(r.text or "", add_special_tokens=False).ids, 0])
    assert sum(len(r.parts) for r in got) == packing.packed(df, capacity=16, block=4).count()


# 13


def plain_features(text, n):
    words = importance_word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


importance_word = __import__("re").compile(importance.FEATURE_WORD)


def plain_importance(texts, target, n, buckets, percent, least):
    """(words, n_features, weight, score, rank) of each row."""
    of = lambda fs: collections.Counter(zlib.crc32(f.encode()) % buckets for f in fs)
    found = [plain_features(t, n) for _, t in texts]
    own, aim = sum((of(f) for _, f in found), collections.Counter()), sum((of(plain_features(t, n)[1]) for t in target), collections.Counter())
    S, T = own.total(), aim.total()
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (S + buckets) / ((own[b] + 1) * (T + buckets)))) for b in own}
    rows = []
    for (i, _), (words, fs) in zip(texts, found, strict=True):
        weight = sum(gain[b] * k for b, k in of(fs).items())
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append([words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((k for k, r in enumerate(rows) if r[0] >= least), key=lambda k: (-rows[k][3], texts[k][0]))
    rank = {k: p for p, k in enumerate(order[: len(order) * percent // 100], 1)}
    return [(*r, rank.get(k)) for k, r in enumerate(rows)]


@pytest.mark.parametrize(("which", "n", "buckets", "percent", "least"), [("hard", 1, 10_000, 50, 2), ("docs", 2, 500, 10, 20), ("hard", 3, 7, 100, 0)])
def test_importance(spark, request, which, n, buckets, percent, least):
    df = request.getfixturevalue(which)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    target = [None, "", "dog cat", "One TWO 한국어 é", *[r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(df, aims, n=n, buckets=buckets, percent=percent, least=least).collect()
    want = plain_importance(rows, target, n, buckets, percent, least)
    # a repeated row's rank may go to either
    key = lambda i, r: (i, *r[:4], r[4] is None)
    assert collections.Counter(key(r.doc_id, (r.words, r.n_features, r.weight, r.score, r["rank"])) for r in got) == collections.Counter(key(i, w) for (i, _), w in zip(rows, want, strict=True))
    assert sorted((r["rank"], r.score) for r in got if r["rank"]) == sorted((w[4], w[3]) for w in want if w[4])


def test_importance_of_nothing(spark, edge):  # noqa: F811
    none = spark.createDataFrame([], "text string")
    got = importance.resampled(edge, none).collect()
    assert len(got) == edge.count()
    assert importance.resampled(edge.limit(0), none).count() == 0
    lost = spark.createDataFrame([(None, "w " * 30, *[None] * 10), (1, "w " * 30, *[None] * 10)], DOC)
    r = {x.doc_id: x for x in importance.resampled(lost, none, percent=100).collect()}
    assert (r[None].score, r[None]["rank"], r[1]["rank"]) == (None, None, 1)


def test_importance_by_sql_where_words_are_odd(spark, tmp_path):
    rows = [(i, f"{t} " + "Word wörd 漢字 9 x_y a-b " * 5, "en", "s", 1) for i, t in enumerate(["", "Ünï", " ", "ẞß", "a\0b", "tie", "tie"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "wörd 漢字 漢字"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    same(queries.QUERIES["op13_importance"](spark, str(tmp_path)), queries.ORACLE_SQL["op13_importance"], str(tmp_path))


def test_queries_of_the_tokens(spark):
    """The registered queries on the whole table, by their contracts' columns."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _, _ = plain_alignment([r.text for r in d])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = queries.QUERIES["op11_alignment"](spark, SF)
    assert {tuple(r) for r in got.select(*names).collect()} == {(r.doc_id, *w) for r, w in zip(d, want, strict=True)}
    rows = queries.QUERIES["op12_packing"](spark, SF)
    check_packing(rows.collect(), d, 2048)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert dict(got.dtypes) == {n: "string" if n == "groups_sha256" else "bigint" for n in names}
    assert {t for _, t in queries.QUERIES["op13_importance"](spark, SF).dtypes} == {"bigint"}
