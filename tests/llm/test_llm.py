"""Each operator against a plain version, and on null, empty, long, repeated and clashing input."""

import base64
import collections
import hashlib
import html
import io
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomwell.llm import arc_warc, html_crf, jpeg_dc, license_rules, mixing, near_copies, quality_rules, queries, reshard, simhash, sp_wfst, url_rules
from tests.harness import same

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, fp string, ids string, rate string, shard string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, first=0):
    """Documents with clashing extra columns; the second row is repeated."""
    rows = [(i + first, t, None, None, None, "x", "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[1:2]], DOC).repartition(3)


EDGE = [None, "", " \n\t ", "one", "a b c d e f g h i j k l", "dog cat " * 9000, "é 한국어 \u2028 z\0q \U0001f600", "a\nb\na\nb\n\n" * 5, "dog cat " * 9000, "MIT. Released under the MIT License."]


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1


def plain_stats(t):
    w = WORD.findall(t or "")
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(g)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(g) if n[x] > 1 for k in range(5)})


def test_quality_counts(edge, docs):
    none = quality_rules.DecisionList()
    for df in (edge, docs):
        texts, got = by_id(df), by_id(quality_rules.quality_rules(df, none))
        for i, r in got.items():
            expect = plain_stats(texts[i].text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expect
            assert r.base_failed == (expect[0] < 10 or 100 * expect[4] > 20 * expect[0]) and r.kept == (not r.base_failed)
    assert quality_rules.quality_rules(edge, none).count() == len(EDGE) + 1
    assert quality_rules.quality_rules(edge.limit(0), none).count() == 0


def test_quality_rules_are_learned(spark):
    r = random.Random(1)
    words = lambda n: [r.choice("ab cd ef gh ij kl mn op qr st".split()) + str(r.randint(0, 99)) for _ in range(n)]
    good = [" ".join(words(40)) for _ in range(60)] + [" ".join(words(40)) + " a & b" for _ in range(6)]
    bad = [" ".join(w + r.choice(("***", "###")) for w in words(40)) for _ in range(40)]
    train = docs_of(spark, good + bad)
    labels = spark.createDataFrame([*[(i, int(i < len(good)), 0) for i in range(len(good + bad))], (None, 0, 0), (3, None, 1), (500, 0, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(train, labels)
    assert rules.rules
    fresh = docs_of(spark, [" ".join(words(30)) for _ in range(20)] + [" ".join(w + "***" for w in words(30)) for _ in range(20)], 1000)
    got = by_id(quality_rules.quality_rules(fresh, rules))
    assert all(got[1000 + i].kept == (i < 20) for i in range(40))
    kept = quality_rules.keep_good(fresh, rules)
    assert kept.columns == fresh.columns and kept.filter("doc_id >= 1020").count() == 0
    assert quality_rules.learn(train, labels.limit(0)).rules == []
    assert quality_rules.learn(train.limit(0), labels).rules == []


# 2


def test_html_crf_held_out():
    chain, hit, kept, real = html_crf.default_chain(), 0, 0, 0
    for page, y in html_crf.labelled_pages(120, seed=77):
        got = chain.viterbi(html_crf.leaf_blocks(page))
        assert len(got) == len(y)
        hit, kept, real = hit + sum(a & b for a, b in zip(got, y, strict=True)), kept + sum(got), real + sum(y)
    assert hit / kept > 0.97 and hit / real > 0.97


def test_viterbi_is_the_best_path():
    chain, r = html_crf.default_chain(), random.Random(5)
    for _ in range(40):
        page = "".join(r.choice(("<p>Some text here.", "<div class=ad>Buy now</div>", "<nav><a href=x>Home</a></nav>", "<h1>Title", "<li><a href=y>more")) for _ in range(r.randint(1, 7)))
        blocks = html_crf.leaf_blocks(page)
        s, tr = [chain.score(b) for b in blocks], chain.transition

        def total(y, s=s, tr=tr):
            return chain.start * y[0] + sum(a * b for a, b in zip(s, y, strict=True)) + sum(tr[a][b] for a, b in zip(y, y[1:], strict=False))

        every = [[k >> i & 1 for i in range(len(s))] for k in range(1 << len(s))]
        assert abs(total(chain.viterbi(blocks)) - max(map(total, every))) < 1e-9


def test_html_pages(spark):
    page = """<!doctype html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>See this</a></ul></aside>
    <article><h1>A &amp; B</h1><p>First <b>bold</b>\n  text with a <a href=/x>link</a> inside.<p>Second&nbsp;one<br>goes on.<div class="ad">Buy this now!</div><ul><li>item one.<li>item two.</ul></article>
    <section class="comments"><h2>Comments</h2><p>I like it.</p></section><form class="newsletter"><p>Subscribe to us.</p><button>Go</button></form><script>var a="<p>x</p>";</script><footer>&copy; me</footer>"""
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<script>x"), (1, "u", page)], "page_id long, url string, html string")
    got = html_crf.extract(pages).collect()
    assert len(got) == 5 and html_crf.extract(pages.limit(0)).count() == 0
    one = next(r for r in got if r.page_id == 1)
    assert one.text == "A & B\n\nFirst bold text with a link inside.\n\nSecond one goes on.\n\nitem one.\n\nitem two." and one.n_chars == len(one.text)
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id != 1)


def test_html_head_without_end():
    rest = "<article><h1>A title</h1><p>Some text.</p></article>"
    expect = [b.text for b in html_crf.leaf_blocks(f"<html><head><title>no</title></head><body>{rest}")]
    assert expect == ["A title", "Some text."]
    for start in ("<html><head><title>no</title><meta charset=x><body>", "<head><title>no</title><style>p{}</style>", "<head><title>no</title><noscript><link href=x></noscript><script>x</script><BODY class=b>"):
        assert [b.text for b in html_crf.leaf_blocks(start + rest)] == expect
    assert [b.text for b in html_crf.leaf_blocks("<head><title>no</title><span>One</span> two")] == ["One two"]
    assert [b.text for b in html_crf.leaf_blocks("<head><title>no</title> Plain text<p>two")] == ["Plain text", "two"]
    assert [b.text for b in html_crf.leaf_blocks("<head><template><p>x</p></template><noscript><p>x</p><img src=x></noscript><title>no</title></head><p>two")] == ["two"]


def test_html_of_other_languages_and_tables():
    body = "<article><h1>Titel</h1><p>Ein langer Absatz mit vielen Worten und einem Ende.</p><p>Noch einer, der ebenso lang ist wie jener davor.</p></article>"
    page = f'<body><table><tr><td><a href=/>Home</a></td><td><a href=/b>Produkte</a></td></tr></table>{body}<div class="kommentare"><h3>Kommentare</h3><p>Das gefaellt mir sehr.</p></div><div class="impressum"><p>Firma und Sitz.</p></div></body>'
    assert html_crf.main_text(page, html_crf.default_chain()) == "Titel\n\nEin langer Absatz mit vielen Worten und einem Ende.\n\nNoch einer, der ebenso lang ist wie jener davor."


def test_html_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in queries.op2_html_extraction(spark, SF).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)


# 3


def test_mixing_meets_targets(spark):
    n = 400
    rows = [(i, float(20 + i % 7), [0.9, 0.1, 0.0] if i % 4 else [0.1, 0.8, 0.1]) for i in range(n)]
    narrow = spark.createDataFrame(rows, "id long, __tokens double, __posterior array<double>")
    targets = {"a": 0.6, "b": 0.38, "c": 0.02}
    rates = mixing.solve(narrow, list(targets), targets, budget=6000.0, pull=1e-6, most_steps=300, tolerance=1e-6)
    got = [r[0] for r in narrow.select(rates.column(F.col("__posterior"))).collect()]
    t, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    reached = (np.array(got) * t) @ p
    assert min(got) >= 0 and np.allclose(reached / t.sum(), rates.reached, rtol=1e-6)
    # the plain optimum of the same problem by many small steps
    x, share, goal = np.ones(n), t @ p / t.sum(), np.array(list(targets.values())) * 6000 / t.sum()
    for _ in range(20000):
        x = np.maximum(0, x - 0.5 * (p @ (((x * t) @ p / t.sum() - goal) / share) + 1e-6 * (x - 1)))
    best = lambda y: (((((y * t) @ p / t.sum()) - goal) ** 2) / share).sum()
    assert best(np.array(got)) <= best(x) + 1e-5


def test_mixing_reaches_targets_of_soft_posteriors(spark):
    """With the values that the queries use: overlapping posteriors, targets that can be met."""
    r = random.Random(9)
    rows = []
    for _ in range(600):
        low, toxic = 0.3 + 0.08 * r.random(), 0.2 + 0.05 * r.random()
        rows.append((1.0 + r.randint(20, 60), [1 - low - toxic, low, toxic]))
    narrow = spark.createDataFrame(rows, "__tokens double, __posterior array<double>").cache()
    t, p = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
    targets = dict(zip(("clean", "low", "toxic"), [float(x) for x in p[p[:, 1] < 0.31].mean(axis=0)], strict=True))
    budget = float(t.sum() * 0.3)
    rates = mixing.solve(narrow, list(targets), targets, budget=budget)
    got = np.array([x[0] for x in narrow.select(rates.column(F.col("__posterior"))).collect()])
    share, goal, pull = t @ p / t.sum(), np.array(rates.goals), rates.pull
    reached = (got * t) @ p / t.sum()
    assert got.min() >= 0 and np.allclose(reached, rates.reached, rtol=1e-9)
    slope = p @ ((reached - goal) / share) + pull * (got - 1)
    assert np.abs(got - np.maximum(0, got - slope)).max() < 1e-5  # the projected gradient
    x = np.ones(len(t))
    for _ in range(20000):  # the plain optimum of the same problem by many small steps
        x = np.maximum(0, x - 0.9 * (p @ (((x * t) @ p / t.sum() - goal) / share) + pull * (x - 1)))
    assert np.abs(reached - (x * t) @ p / t.sum()).max() < 1e-4 * goal.min() and rates.residual <= 1e-6


def test_mixing_keeps_clean_documents_where_others_are_rare(spark):
    for low, toxic in ((2, 200), (200, 2), (2, 2), (0, 2)):
        rows = [[0.998, 0.001, 0.001]] * 1000 + [[0.02, 0.97, 0.01]] * low + [[0.02, 0.01, 0.97]] * toxic
        narrow = spark.createDataFrame([(30.0, p) for p in rows], "__tokens double, __posterior array<double>")
        rates = mixing.solve(narrow, list(mixing.TARGETS), mixing.TARGETS)
        got = [x[0] for x in narrow.select(rates.column(F.col("__posterior")), F.col("__posterior")[0]).collect() if x[1] > 0.9]
        assert len(got) == 1000 and 0.9 < min(got) and max(got) < 1.1


def test_mixing_documents(spark, docs):
    labelled = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", mixing.domain_of_labels().alias("domain"))
    got = by_id(mixing.document_rates(docs, labelled))
    assert len(got) == docs.count() and all(r.rate >= 0 and abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 for r in got.values())
    by = collections.defaultdict(list)
    for r in labelled.collect():
        if r.doc_id in got:
            by[r.domain].append(got[r.doc_id].rate)
    assert np.mean(by["clean"]) > 3 * np.mean(by["low"] + by["toxic"])


def test_rates_of_the_query_by_brute_force(spark):
    """op3's rates on the whole table: the plain optimum from its own probabilities, many small steps."""
    rows = queries.op3_mixing(spark, SF).collect()
    t, p, got = np.array([r.n_tokens for r in rows], float), np.array([[r.p_clean, r.p_low, r.p_toxic] for r in rows]), np.array([r.rate for r in rows])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.n_tokens == len(WORD.findall(texts[r.doc_id] or "")) for r in rows)
    share = t @ p / t.sum()
    target = np.array([mixing.TARGETS[d] for d in ("clean", "low", "toxic")])
    goal = target * share[0] / target[0]
    x = np.ones(len(t))
    for _ in range(60000):
        x = np.maximum(0, x - 0.9 * (p @ (((x * t) @ p / t.sum() - goal) / share) + 1e-3 * (x - 1)))
    reached = lambda y: (y * t) @ p / t.sum()
    assert got.min() >= 0 and np.abs(reached(got) - reached(x)).max() < 1e-3 * goal.min()
    assert np.abs(reached(got) - goal).max() < 0.05 * goal[0]


def test_mixing_edges(spark, edge):
    one = spark.createDataFrame([(4, "clean"), (5, "clean"), (None, "low"), (6, None), (7, "low"), (7, "clean")], "doc_id long, domain string")
    for labelled in (one, one.limit(0)):
        out = mixing.mixed(edge, labelled)
        assert out.columns == edge.columns and out.count() == len(EDGE) + 1
    assert mixing.mixed(edge.limit(0), one).count() == 0
    two = spark.createDataFrame([(4, "clean"), (5, "low")], "doc_id long, domain string")
    assert mixing.document_rates(edge, two).count() == len(EDGE) + 1


# 4


def test_pieces_equal_the_library():
    t, lib, r = sp_wfst.Transducer(open(sp_wfst.MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=sp_wfst.MODEL), random.Random(2)
    texts = [x for x in EDGE if x] + ["".join(r.choice("aabetion  \n▁éñ中🎉01<s>") for _ in range(r.randint(0, 60))) for _ in range(500)]
    for x in texts:
        ids = t.encode(x)
        assert ids == lib.encode(x) and t.decode(ids) == x.replace("▁", " ")


def test_shortest_path_of_a_unigram_model():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in (("<unk>", 0, 2), ("▁", -2, 1), ("a", -1, 1), ("b", -1.5, 1), ("ab", -2, 1), ("ba", -0.5, 1), ("▁ab", -4, 1)):
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces, m.normalizer_spec.remove_extra_whitespaces = 1, True, True, False
    t = sp_wfst.Transducer(m.SerializeToString())
    score = {p.piece: p.score for p in m.pieces if p.type == 1}

    def every(x):
        return [[]] if not x else [[x[:k], *rest] for k in range(1, len(x) + 1) if x[:k] in score for rest in every(x[k:])]

    for x in ("ab", "aba", "abab ba", "bbaab"):
        best = max(every("▁" + x.replace(" ", "▁")), key=lambda s: sum(score[p] for p in s))
        assert sum(score[t.surface[i]] for i in t.encode(x)) == pytest.approx(sum(score[p] for p in best))


def normalised_model(kind, pieces, rule="nmt_nfkc", **spec):
    """A model of given pieces with a published character map."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    del m.pieces[:]
    for piece, score, type_ in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *pieces]:
        m.pieces.add(piece=piece, score=score, type=type_)
    m.trainer_spec.model_type, m.trainer_spec.vocab_size = kind, len(m.pieces)
    n = m.normalizer_spec
    n.add_dummy_prefix, n.escape_whitespaces, n.remove_extra_whitespaces = True, True, True
    for k, v in spec.items():
        setattr(n, k, v)
    return m.SerializeToString()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("kind", [1, 2])
def test_normalised_models_equal_the_library(kind, rule):
    r = random.Random(kind)
    texts = ["", " ", "\u200b", "\u3000x\u3000", "ﬁne ①②", "Ａ㌔ｶﾞ <x><sep>Ａ", "e\u0301 é ǅ \r\n\t a", "<sep> <sep>", "\ufb01<sep>\ufb01 a<", "가 각 ㈜"]
    signs = "aｂABé①ﬁ ガｶﾞ㌔\u3000\u0301<sep>가한①\t한"
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(400)]
    letters = sorted({c for c in "▁abABéfine12kgガ가한キログラムｂ株()<sepx>"})
    pieces = [(c, -5.0 - 0.01 * i, 1) for i, c in enumerate(letters)] + [("▁a", -4.0, 1), ("ab", -3.5, 1), ("fi", -3.0, 1), ("キロ", -2.5, 1), ("<sep>", 0.0, 4), ("e▁", -4.5, 1)]
    for spec in ({}, {"remove_extra_whitespaces": False}, {"add_dummy_prefix": False}):
        model = normalised_model(kind, pieces, rule, **spec)
        t, lib = sp_wfst.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        for x in texts:
            assert t.normalise(x) == lib.normalize(x), (rule, spec, x)
            assert t.encode(x) == lib.encode(x), (rule, spec, x)


def test_encoding_rows(edge):
    out = sp_wfst.encode(edge)
    got = by_id(out)
    assert out.count() == len(EDGE) + 1 and all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())
    assert got[0].ids == [] and got[1].ids == []
    assert {r.doc_id: r.text for r in sp_wfst.decode(out).collect()} == {i: t or "" for i, t in enumerate(EDGE)}
    assert sp_wfst.encode(edge.limit(0)).count() == 0


# 5


def plain_fingerprint(t, size=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 3):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, edge, docs):
    for df in (edge, docs):
        rows = sorted(df.select("doc_id", "text").collect())
        got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()}
        fps = [plain_fingerprint(r.text) for r in rows]
        comp = plain_components(fps)
        assert got == {(r.doc_id, f, rows[c].doc_id) for r, f, c in zip(rows, fps, comp, strict=True)}
    assert simhash.near_duplicates(edge.limit(0)).count() == 0
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(edge).collect()}})


def test_trie_join_of_dense_fingerprints(spark):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in {r.randrange(64) for _ in range(r.randint(0, 6))}) for c in centres for _ in range(150)})
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    expect = plain_components(fps)
    for heavy in (16, 2048):  # with tries dealt out as pairs of subtrees, and whole
        links = [(a.u & (1 << 64) - 1, a.v & (1 << 64) - 1) for a in simhash.stars(table, heavy=heavy).collect()]
        root = {f: f for f in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            assert a in root and b in root
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert [find(f) for f in fps] == [fps[c] for c in expect]


# 6


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(spark, version):
    pages = [(1, "http://a/b c", "<p>é</p>"), (2, None, None), (3, "http://x", "<p>é</p>"), (4, "u", ""), (5, "u\n2", "line\r\n\r\nWARC/1.1 x\n" * 50), (None, "n", "<p>é</p>"), (3, "http://x", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = arc_warc.pages_through_archives(df, version).collect()
    assert len(got) == len(pages) and all(r.block_ok for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    sha = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    for i, _, body in pages:
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len((body or "").encode()), sha(body or ""))
            assert r.payload in ((body or "",) if r.record_type == "response" else (None,))
    assert [(r.record_type, r.refers_to) for r in by[1] + by[2] + by[4] + by[5] + by[None]] == [("revisit", 3), ("revisit", 4), ("response", None), ("response", None), ("revisit", 3)]
    assert sorted((r.record_type, r.refers_to or 0) for r in by[3]) == [("response", 0), ("revisit", 3)]
    assert arc_warc.pages_through_archives(df.limit(0)).count() == 0


def test_arc_lines():
    block = b"filedesc://x 0.0.0.0 20240101 text/plain 76\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    body = b"1 0 Org\n" + arc_warc.ARC_FIELDS[1].encode() + b"\n"
    block = b"filedesc://x 0.0.0.0 20240101 text/plain %d\n%s\n" % (len(body), body)
    assert [r["URL"] for r in arc_warc.parse_arc(block + b"u 1.1.1.1 20240102030405 text/html 3\na\nb\n")] == ["u"]
    for bad in (b"u 1.1.1.1 20240102030405 text/html 99\nab\n", b"u 1.1.1.1 text/html 2\nab\n"):
        with pytest.raises(ValueError):
            list(arc_warc.parse_arc(block + bad))
    with pytest.raises(ValueError):
        list(arc_warc.parse_arc(b"u 1.1.1.1 20240102030405 text/html 2\nab\n"))


def test_legacy_arc(spark, tmp_path):
    """Latin-1 payloads, a look-up, an empty file, and a record without an HTTP header's end."""
    body = b"2 0 Org\n" + arc_warc.ARC_FIELDS[2].encode() + b"\n"
    head = b"filedesc://old.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 old.arc %d\n%s\n" % (len(body), body)
    latin = b"HTTP/1.0 200 OK\r\nX-Name: caf\xe9\r\n\r\n<p>caf\xe9</p>\nend\n"
    rows = [(b"http://a/caf%E9", latin), (b"dns:a", b"20010203040506\na. 1 IN A 1.1.1.1\n"), (b"http://b/", b"HTTP/1.0 204 No\r\n")]
    data = head + b"".join(b"%s 1.1.1.1 20010203040506 text/html 200 - - 0 old.arc %d\n%s\n" % (u, len(b), b) for u, b in rows)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.txt").write_bytes(data)
    (tmp_path / "arc" / "none.txt").write_bytes(b"")
    arc_warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {(r.record_type, r.target_uri): r for r in arc_warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert set(got) == {("warcinfo", None), ("response", "http://a/caf%E9"), ("resource", "dns:a"), ("response", "http://b/")} and all(r.block_ok for r in got.values())
    one = got["response", "http://a/caf%E9"]
    assert bytes(one.content) == b"<p>caf\xe9</p>\nend\n" and one.payload == "<p>caf\ufffd</p>\nend\n" and one.date == "2001-02-03T04:05:06Z"
    assert bytes(got["resource", "dns:a"].content) == rows[1][1] and got["response", "http://b/"].payload_bytes == 0


def test_archives_by_sql_with_null_ids(spark, tmp_path):
    """Records without an id, beside equal payloads with ids and without any, and repeated ones."""
    rows = [(1, "u", "a"), (None, "u", "a"), (None, "u", "a"), (None, "v", "b"), (None, None, "b"), (4, "u", None), (None, "u", ""), (5, "u", "c"), (5, "u", "c"), (6, "u", "c")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    same(queries.QUERIES["op6_warc"](spark, str(tmp_path)), queries.ORACLE_SQL["op6_warc"], str(tmp_path))


def test_foreign_archives(spark, tmp_path):
    """Bare line feeds in HTTP headers, an id header that is none, coded lengths, and a revisit of another writer."""
    body = b"1 0 Org\n" + arc_warc.ARC_FIELDS[1].encode() + b"\n"
    head = b"filedesc://x 0.0.0.0 20240101 text/plain %d\n%s\n" % (len(body), body)
    bare = [b"HTTP/1.0 200 OK\nX-Page-Id: %s\nTransfer-Encoding: chunked\nContent-Length: 7\n\n%s" % x for x in ((b"abc", b"one"), (b"2", b"two"), (b"3", b"two"))]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.txt").write_bytes(head + b"".join(b"http://u 1.1.1.1 20240102030405 text/html %d\n%s\n" % (len(b), b) for b in bare))
    arc_warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {(r.page_id, r.record_type, r.payload_bytes, r.payload, r.refers_to) for r in arc_warc.read_warc(spark, str(tmp_path / "warc")).collect() if r.record_type != "warcinfo"}
    assert got == {(None, "response", 3, "one", None), (3, "response", 3, "two", None), (2, "revisit", 3, None, 3)}
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 5\r\n\r\n"
    foreign = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <x>\r\nWARC-Date: 2024\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "w.txt").write_bytes(foreign)
    r = arc_warc.read_warc(spark, str(tmp_path / "other")).first()
    assert (r.record_type, r.payload_bytes, r.payload_digest, r.block_ok) == ("revisit", None, None, False)


# 7


def test_transfers_move_least():
    r = random.Random(4)
    for _ in range(30):
        n, m = r.randint(1, 4), r.randint(1, 4)
        sizes = [r.randint(0, 3) for _ in range(n)]
        room = [r.randint(0, 3) for _ in range(m)]
        room[0] += max(0, sum(sizes) - sum(room))
        cost = np.array([[r.randint(0, 4) for _ in range(m)] for _ in range(n)])
        got = reshard.min_cost_transfers(sizes, room, cost)
        for i in range(n):
            assert sum(t.size for t in got if t.source == i) == sizes[i]
        assert all(sum(t.size for t in got if t.target == j) <= room[j] for j in range(m))
        units = [i for i, s in enumerate(sizes) for _ in range(s)]
        best = {tuple(room): 0}
        for i in units:
            new = {}
            for left, c in best.items():
                for j in range(m):
                    if left[j]:
                        k = (*left[:j], left[j] - 1, *left[j + 1 :])
                        new[k] = min(new.get(k, 99999), c + int(cost[i, j]))
            best = new
        assert sum(t.size * cost[t.source, t.target] for t in got) == min(best.values())
    with pytest.raises(ValueError):
        reshard.min_cost_transfers([5], [4])


def test_resharding(spark, edge, docs):
    for df, shards in ((edge, 3), (docs, 40)):
        old = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")) % 5
        out, transfers = reshard.reshard(df, old, shards, block_rows=7)
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in df.collect())
        by = collections.defaultdict(list)
        for r in rows:
            data = (r.text or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
        total, sizes = sum(r.size for r in rows), collections.Counter()
        for r in rows:
            sizes[zlib.crc32((r.text or "").encode()) % 5] += r.size
        caps = reshard.equal_capacities(total, shards)
        assert sum(t.size for t in transfers if t.source != t.target) == sum(max(0, sizes[i] - (caps[i] if i < shards else 0)) for i in range(5))
        largest = max(r.size for r in rows)
        assert all(abs(sum(r.size for r in by[j]) - caps[j]) <= 3 * largest for j in range(shards))
    assert reshard.reshard(edge.limit(0), F.lit(0), 4)[0].count() == 0


# 8 and 10, and 6 by SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_url_rules(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("b.com", "/", "block"), ("b.com", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = [None, "", "x.org/", "HTTP://A.ORG/x", "http://org/", "http://borg/", "http://org", "https://m.Example.org/es/1?q#f", "http://example.org/en/12", "http://example.org/e", "http://x.b.com/fr/", "http://com/de/?://org/", "a b://é.com/fr/ü"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(3, urls[3], "x", "y")], "page_id long, url string, host string, rule string")
    known = [*queries.URL_RULES, ("b.com", "/", "block")]
    out = url_rules.url_verdicts(pages, rules)
    assert out.count() == len(urls) + 1
    for i, r in by_id(out, "page_id").items():
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[i] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in known if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert url_rules.url_verdicts(pages.limit(0), rules).count() == 0 and url_rules.url_verdicts(pages, rules.limit(0)).filter("rule is null").count() == len(urls) + 1


def test_licenses(spark, edge):
    texts = ["x\nReleased under the MIT License.\ny. Licensed under the Apache License, Version 2.0!", "Permission is hereby granted", None, "This program is free software; all rights reserved. All rights reserved.", "LICENSED  under CC-BY-NC 4.0."]
    got = by_id(license_rules.license_scan(docs_of(spark, texts)))
    assert [got[i].licenses for i in range(5)] == ["Apache-2.0,MIT", "", "", "", "CC-BY-NC-4.0"]
    assert got[3].unmatched == ";RESERVED;;RESERVED;" and got[0].sentence_ids == ";MITref;;APACHE2ref;" and got[2].n_sentences == 0
    notice = ". ".join(x for i, x in license_rules.SENTENCES if i in ("MITgrant", "MITnotice", "ASIS"))
    r = license_rules.license_scan(docs_of(spark, [notice])).first()
    assert r.licenses == "MIT" and r.unmatched == ""
    assert by_id(license_rules.license_scan(edge))[9].licenses == "MIT" and license_rules.license_scan(edge.limit(0)).count() == 0


MIT_NOTICE = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
BSD_NOTICE = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_NOTICE = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, go on."""


# as projects write them, with what they mean; the last ones refer to no licence
REFERENCES = [
    ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"), ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", "MIT"),
    ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */", "MIT OR Apache-2.0"), ("# SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"), ("// SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"),
    ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("Licensed under the Apache License 2.0", "Apache-2.0"), ("The MIT License (MIT)", "MIT"), ("The MIT License", "MIT"), ("## License: GPLv3", "GPL-3.0-only"),
    ("Distributed under the Boost Software License. See it.", "BSL-1.0"), ("Released under the 2-Clause\nBSD License", "BSD-2-Clause"), ("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("This software is released under the ISC license!", "ISC"),
    ("Our licence is none of these", ""), ("The MIT campus has a license office", ""), ("c++ and MIT", ""),
]


def test_licences_as_projects_name_them(spark, tmp_path):
    docs_of(spark, ["Read me.\n\n" + text + "\nMore text here." for text, _ in REFERENCES]).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(queries.QUERIES["op10_license_scan"](spark, str(tmp_path)))
    assert [(text, got[i].licenses) for i, (text, _) in enumerate(REFERENCES)] == REFERENCES
    same(queries.QUERIES["op10_license_scan"](spark, str(tmp_path)), queries.ORACLE_SQL["op10_license_scan"], str(tmp_path))


def test_wrapped_licences(spark):
    texts = [MIT_NOTICE, BSD_NOTICE, GPL_NOTICE, " * " + GPL_NOTICE.replace("\n", "\r\n * "), MPL_NOTICE, "licensed under the\nmit licence"]
    got = by_id(license_rules.license_scan(docs_of(spark, texts)))
    assert [got[i].licenses for i in range(6)] == ["MIT", "BSD-3-Clause", "GPL-3.0-or-later", "GPL-3.0-or-later", "MPL-2.0", ""]
    assert [got[i].sentence_ids for i in range(4)] == [";MITgrant;;MITnotice;;ASIS;", ";RESERVED;;BSDredist;;BSDendorse;", ";GPLfree;;GPLhope;", ";GPLfree;;GPLhope;"]
    assert [got[i].unmatched for i in range(4)] == ["", ";RESERVED;", "", ""]


def test_wrapped_licences_by_sql(spark, tmp_path):
    texts = [MIT_NOTICE, BSD_NOTICE, GPL_NOTICE, MPL_NOTICE, APACHE_NOTICE, None, "", "SPDX-License-Identifier: LGPL-2.1-or-later\nAll rights reserved. Released under the MIT License"]
    docs_of(spark, texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = license_rules.license_scan(spark.read.parquet(str(tmp_path / "documents.parquet")))
    same(got, queries.ORACLE_SQL["op10_license_scan"], str(tmp_path))
    assert [by_id(got)[i].licenses for i in (4, 7)] == ["Apache-2.0", "LGPL-2.1-or-later,MIT"]


APACHE_NOTICE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""


# 9


def decode_plainly(data):
    """One bit after another, for single-component images."""
    j = jpeg_dc.parse(data)
    scan, out = j.scans[0], []
    codes = [{(n, c): s for s, (c, n) in jpeg_dc.huffman(t)[2].items()} for t in (scan.dc[0], scan.ac[0])]
    for part in re.split(rb"\xff[\xd0-\xd7]", data[scan.begin : scan.end]):
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff"))
        at, last = 0, 0

        def symbol(table):
            nonlocal at
            for n in range(1, 17):
                s = table.get((n, int(bits[at : at + n], 2)))
                if s is not None:
                    at += n
                    return s
            raise ValueError

        def number(size):
            nonlocal at
            v = int(bits[at : at + size], 2) if size else 0
            at += size
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        while len(bits) - at >= 8 or bits[at:].strip("1"):
            block, k = [0] * 64, 1
            last += number(symbol(codes[0]))
            block[0] = last
            while k < 64:
                s = symbol(codes[1])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = number(s & 15)
                k += 1
            out.append(block)
            if scan.restart == 1:
                break
    return out


def test_jpeg_store():
    r = random.Random(6)
    texts = [*[t for t in EDGE if t is None or len(t) < 900], *["".join(r.choice("\0\0\0Aé~한") for _ in range(r.randint(1, 200))) for _ in range(20)]]
    payloads = [jpeg_dc.payload_of(t) for t in texts]
    files = jpeg_dc.store(payloads)
    for p, f, (back, feature) in zip(payloads, files, jpeg_dc.load(files), strict=True):
        assert back == p and len(p) % 64 == 0 and len(p) > 0
        plain = b"".join(bytes(b) for b in decode_plainly(f))
        assert plain[: len(p)] == p and not plain[len(p) :].strip(b"\0")
        assert re.fullmatch(r"\d+x\d+:[0-9a-f]{16}", feature)


def test_jpeg_segments_behind_a_scan():
    """A comment with bytes like a restart's, behind short and long scans alike."""
    for n in (3, 100, 5000):
        payload = bytes(random.Random(n).randrange(256) for _ in range(64 * n))
        (plain,) = jpeg_dc.store([payload])
        said = b"\xff\xfe" + struct.pack(">H", 14) + b"bytes=%06d" % (64 * n)
        more = plain[:-2] + said[:-2] + b"\xff\xd0" + plain[-2:]
        image = jpeg_dc.parse(more)
        assert image.scans[0].end == len(plain) - 2
        (found,) = jpeg_dc.decode([(more, image)])
        assert found[0].astype(np.uint8).tobytes()[: len(payload)] == payload


def test_jpeg_of_long_texts_takes_bounded_memory():
    """A text in more than one slice: the same bytes, and memory of some times the text, not of a hundred."""
    import tracemalloc

    payload = jpeg_dc.payload_of("".join(chr(32 + i * i % 90) for i in range(2_500_000)))
    tracemalloc.start()
    files = jpeg_dc.store([payload])
    (read, _), *_ = jpeg_dc.load(files)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read == payload and most < 20 * len(payload) + 60_000_000, most / len(payload)
    small = payload[: 64 * 40_000]
    assert jpeg_dc.load(jpeg_dc.store([small, payload[:64], small]))[2][0] == small


def test_jpeg_of_long_texts():
    for n in (1, 1024, 1025, 1024 * 8191, 1024 * 8191 + 1, 2**31 // 64):
        wide = jpeg_dc.blocks_wide(n)
        assert 8 * wide <= 65535 and 8 * -(-n // wide) <= 65535 and (wide == min(n, 1024) or n > 1024 * 8191)


def test_jpeg_rows(edge):
    out = jpeg_dc.text_media(edge)
    assert out.count() == len(EDGE) + 1 and jpeg_dc.text_media(edge.limit(0)).count() == 0
    for i, r in by_id(out).items():
        data = (EDGE[i] or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert by_id(out)[5][1:] == by_id(out)[8][1:]


def colour_jpeg():
    """24 x 16, 4:2:0, one interval: DC only, each block one level higher than the last of its kind."""
    dc, ac = jpeg_dc._dht({s: s + 2 for s in range(12)}), jpeg_dc._dht({0: 2, 1: 2})
    codes, end = jpeg_dc.huffman(dc)[2], jpeg_dc.huffman(ac)[2][0]
    bits = ""
    for c in [0, 0, 0, 0, 1, 2] * 2:
        code, n = codes[3]
        bits += f"{code:0{n}b}" + ("100" if c == 0 else "011") + f"{end[0]:0{end[1]}b}"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    out = io.BytesIO()
    out.write(b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([16]) + b"\x01" * 63)
    out.write(b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 16, 24, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    for k, t in ((0, dc), (16, ac)):
        out.write(b"\xff\xc4" + struct.pack(">HB", 3 + len(t), k) + t)
    out.write(b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00" + scan + b"\xff\xd9")
    return out.getvalue()


def test_colour_jpeg(spark):
    data = colour_jpeg()
    image = jpeg_dc.parse(data)
    (found,) = jpeg_dc.decode([(data, image)], whole=False)
    assert found[0][:, 0].tolist() == [4, 8, 12, 16, 20, 24, 28, 32] and found[1][:, 0].tolist() == [-4, -8]
    assert jpeg_dc.thumbnail(image, found[0][:, 0]).tolist() == [[128 + 8, 128 + 16, 128 + 40], [128 + 24, 128 + 32, 128 + 56]]
    rows = spark.createDataFrame([(1, data), (2, b"no"), (3, None), (4, data[:40]), (1, data)], "k long, media binary")
    got = jpeg_dc.describe(rows, "k", "media").collect()
    assert sorted((r.k, r.width, r.height, r.n_components, r.error is None) for r in got if r.k == 1) == [(1, 24, 16, 3, True)] * 2
    assert all(r.width is None and r.error for r in got if r.k > 1) and len(got) == 5


# The pipeline


def test_pipeline(spark, docs, tmp_path):
    now = docs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = corpus_pipeline.quality(spark, now, SF).cache()
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    for r in docs.collect():
        s = plain_stats(r.text)
        if s[0] < 10 or 100 * s[4] > 20 * s[0]:
            assert r.doc_id not in kept
        elif r.doc_id in good:
            assert r.doc_id in kept
    one = corpus_pipeline.near_duplicates(spark, out, SF).cache()
    rows = sorted(out.collect())
    comp = plain_near_copies([r.text for r in rows])
    assert sorted(r.doc_id for r in one.collect()) == sorted({rows[c].doc_id for c in comp})
    mix = corpus_pipeline.mix(spark, one, SF).cache()
    assert mix.columns == docs.columns and {r.doc_id for r in mix.collect()} <= {r.doc_id for r in one.collect()}
    tokens = corpus_pipeline.tokens(spark, mix, SF)
    lib = sentencepiece.SentencePieceProcessor(model_file=sp_wfst.MODEL)
    texts = {r.doc_id: r.text for r in mix.collect()}
    assert tokens.count() == mix.count() and all(r.ids == lib.encode(texts[r.doc_id]) and r.round_trip for r in tokens.collect())


def test_pipeline_edges(spark, edge):
    cut = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cut.limit(0), SF).count() == 0
        assert stage(spark, cut, SF).count() <= len(EDGE) + 1


def test_near_copies_in_parted_groups(spark):
    """A hub with spokes that are alike only through it, and one text that only a spoke is near to."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(204)], []
    for k in range(60):
        copy = list(base)
        for c in range(4):  # 0.82 to the base, about 0.7 to one another
            copy[10 + 40 * c + r.randrange(30)] = word()
        texts.append(" ".join(copy))
    far = texts[7].split()
    for c in range(3):
        far[20 + 60 * c] = word()
    texts += [" ".join(base), " ".join(far)]
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[i] for i in order]
    for some in (texts, [t for t in texts if t != " ".join(base)]):
        df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
        comp = plain_near_copies(some)
        for most_rows in (2_000, 7):  # groups whole, and in parts
            label = {x.id: x.label for x in near_copies.near_copies(df, most_rows=most_rows)[1].collect()}
            assert all((label[i] == label[j]) == (comp[i] == comp[j]) for i in label for j in label)
        assert sorted(x.doc_id for x in near_copies.keep_one(df).collect()) == sorted(set(comp))


def test_near_copies_by_tries(spark):
    """Fingerprints within the budget are linked by tries, and the pairs whose sets are alike are confirmed."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(300)]
        texts += [" ".join(base), " ".join([*base, word()]), " ".join([word(), *base[3:]])]
    rows = [(i, simhash.majority(near_copies.shingles(t, 5))) for i, t in enumerate(texts)] + [(len(texts), None)]
    signed = lambda fp: fp - (1 << 64) if fp is not None and fp >> 63 else fp
    df = spark.createDataFrame([(i, signed(fp)) for i, fp in rows] + [(99, signed(rows[0][1]))], "node long, fp long")
    root = list(range(len(texts)))
    for i in root:
        near = [root[j] for j in range(len(texts)) if (rows[i][1] ^ rows[j][1]).bit_count() <= near_copies.ERRORS]
        root = [min(near) if x in near else x for x in root]
    pairs = [(x.a, x.b) for x in near_copies.trie_pairs(df).collect()]
    assert (0, 99) in pairs
    found = list(range(100))
    for a, b in pairs:
        found = [min(found[a], found[b]) if x in (found[a], found[b]) else x for x in found]
    assert found[: len(texts)] == root and len(set(root)) < len(texts)
    whole = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    comp = plain_near_copies(texts)
    assert sorted(x.doc_id for x in near_copies.keep_one(whole).collect()) == sorted(set(comp))


def test_near_copies_of_equal_ids(spark):
    rows = [(1, "a b c d e f", x) for x in ("p", "q", None)] + [(None, "a b c d e f", "r"), (None, None, "s"), (None, "", "t"), (2, "A  b c d e f", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    kept = [sorted(near_copies.keep_one(d).collect(), key=repr) for d in (df, df.repartition(5))]
    assert kept[0] == kept[1] and [x.doc_id for x in kept[0]] == [1, None]


def plain_near_copies(texts, least=0.8):
    """The smallest index of each text's component, by all pairs' similarity."""
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n >= least * (len(a) + len(sets[j]) - n) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_pipeline_merges_near_copies(spark, edge, docs):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for k in range(40):
        base = [word() for _ in range(204)]
        texts.append(" ".join(base))
        # so many words replaced, each far from the next: 5 shingles of 200 lost for each
        for changed in (1, 4, 5):  # similarity 0.95, 0.82, 0.78
            copy = list(base)
            for c in range(changed):
                copy[20 + 30 * c] = word()
            texts.append(" ".join(copy).replace(" ", "  ").title() if k % 2 else " ".join(copy))
    for df in (docs_of(spark, texts), docs, edge):
        rows = sorted(df.select("doc_id", "text").distinct().collect())
        comp = plain_near_copies([x.text for x in rows])
        kept = corpus_pipeline.near_duplicates(spark, df, SF)
        assert kept.columns == df.columns
        assert sorted(x.doc_id for x in kept.collect()) == sorted({rows[c].doc_id for c in comp})


# 2 on hard pages


@pytest.mark.parametrize("page", ["<a" * 500_000, "<b>" * 170_000 + "</i>" * 120_000, "<script>" * 125_000, '<a ">' * 200_000, "<a \"'>" * 160_000, "<div>" * 100_000 + "<td>x</td>" * 50_000, "<b>" * 160_000 + "x<hr>" * 100_000, "<b>" * 160_000 + "<body>" * 80_000])
def test_html_of_a_megabyte_is_read_in_linear_time(page):
    chain = html_crf.Chain({}, -1.0, np.zeros((2, 2)), 0.0)
    cpu = lambda f: (time.process_time(), f(), time.process_time())
    whole, _ = min((b - a, 0) for a, _, b in [cpu(lambda: html_crf.main_text(page, chain)) for _ in range(2)])
    assert whole < 6  # seconds; a reader in quadratic time takes hours


def test_html_names_of_deep_elements_do_not_add_up():
    page = "".join(f'<div class="{a}{b}{c}x">' for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefghijklmnop") + "deep"
    known = html_crf.Contexts(frozenset({"in=div", "name=abcx"}))
    (block,) = html_crf.leaf_blocks(page, known)
    assert block.text == "deep" and block.context.features == {"in=div", "name=abcx"}
