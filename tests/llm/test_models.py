"""Language, quality and scoring models: held-out accuracy, closed forms, and edge cases."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from helpers import EDGE, documents

from codexmill.llm import language, quality, scoring

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["schu", "ung", "er", "ver"], "cc": ["ión", "os", "ñe", "lla"]}


def sentence(rng, lang, n=12):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, sentence(rng, lang), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(SYLLABLES), 240))], "doc_id long, text string, lang string")


def test_codewords_differ():
    for n in (2, 3, 5, 6, 40):
        code = language.codewords(n)
        assert len({tuple(x) for x in code}) == n and all(len(set(c)) == 2 for c in code.T)


def test_language_held_out(spark, labelled):
    model = language.fit(labelled.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r.lang_pred for r in language.predict(labelled.where("doc_id % 4 = 2"), model).collect()}
    want = {r.doc_id: r.lang for r in labelled.where("doc_id % 4 = 2").collect()}
    assert got == want


def test_language_edges(spark, labelled):
    model = language.fit(labelled)
    docs = documents(spark, [*EDGE, "123 !?", "ж"])
    rows = language.predict(docs, model).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[-2].lang_pred == "und" and rows[-1].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == docs.count()
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    nobody = language.fit(labelled.where("false"))
    assert {r.lang_pred for r in language.predict(docs, nobody).collect()} == {"und"}
    assert language.keep_identified(docs, nobody).count() == docs.count() - 4
    filled = language.keep_identified(labelled.selectExpr("doc_id", "text", "cast(null as string) as lang").limit(3), model).collect()
    assert all(r.lang in SYLLABLES for r in filled)


def test_grams_stay_in_their_text():
    one = language.grams([b"abc"])
    both = language.grams([b"xyz", b"abc"])
    a, b = both[1][1]
    assert all((x[slice(*one[1][0])] == y[a:b]).all() for x, y in zip(one[0], both[0], strict=True))


def test_indicators_are_those_of_each_text():
    alone = [quality.indicators([x])[0].tolist() for x in (b"ab ab", b"", b"x")]
    assert [x.tolist() for x in quality.indicators([b"ab ab", b"", b"x"])] == alone
    assert set(quality.mark_grams(b"a a a b").tolist()) > set() != set(quality.mark_grams(b"a b a").tolist())
    assert quality.mark_grams(b"one").tolist() == [] and (quality.mark_grams(b"x " * 50) >= quality.BUCKETS).all()
    assert all((x[:-1] < x[1:]).all() and x.max() < quality.FEATURES for x in quality.indicators([b"a a b", b"c c c c"]))


def test_marks_are_their_n_grams():
    marks = [0, 1, 1, 0, 0, 1]
    words = [0]
    for m in marks:
        words.append(words[-1] + (not m))
    text = " ".join(map(str, words)).encode()
    want = set()
    for n in quality.MARK_ORDERS:
        for i in range(len(marks) - n + 1):
            code = int("1" + "".join(map(str, marks[i : i + n])), 2)
            want.add(quality.BUCKETS + (code * 2654435761 % 2**32 >> 20))
    assert set(quality.mark_grams(text).tolist()) == want


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] + 0.3 > 0, 1.0, -1.0)
    rows = [(np.arange(3), r) for r in x]
    w, b = quality.dual_coordinate_descent(rows, y, np.ones(60), 3, epochs=400)
    value = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = value(w, b)
    for _ in range(300):
        assert best <= value(w + rng.normal(size=3) * 0.05, b + rng.normal() * 0.05) + 1e-3


def test_quality_held_out(spark):
    rng = random.Random(2)
    texts = [(sentence(rng, "aa") if i % 3 else sentence(rng, "aa").upper() + "!!") for i in range(300)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(300)] + [(None, 1, 0), (7, None, 0), (8, 5, 0)], "doc_id long, quality int, toxic int")
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    from pyspark.sql import functions as F

    from codexmill.llm import common

    model = quality.fit(docs, labels.where(common.outside_fold("doc_id", 5, 0)))
    got = {r.doc_id: r.score for r in quality.predict(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in held)
    assert docs.where(common.is_fold("doc_id", 5, 0)).count() == len(held)
    edge = quality.predict(documents(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge)
    few = quality.fit(docs, labels.where("doc_id IN (0, 1, 2, 3)"))  # both classes are there
    assert len({round(r.score, 6) for r in quality.predict(docs.limit(3), few).collect()}) > 1
    few = quality.fit(docs, labels, rows=40)
    assert sum((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in quality.predict(docs, few).collect()) > 250
    blind = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.predict(docs.limit(3), blind).collect()} == {0.5}
    assert quality.fit(docs, labels.withColumn("quality", F.lit(1))).scores([np.zeros(0, np.int32)])[0] > 0.5


def test_code_length_is_the_weighted_tree_s_next_step(spark):
    """Scoring one more byte costs the ratio of the tree's probabilities with and without it."""
    train = [b"abab", b"abc", b"", b"ba ba"]
    model = scoring.Model(spark.createDataFrame([(t.decode(),) for t in train], "text string"))
    part = next(scoring._slices(model.nodes))
    before = _with_first_byte(train, None, scoring.DEPTH)
    for byte in (97, 98, 122, 255, 32, 0x80):
        code = np.array([int.from_bytes(bytes([255, 255, 255, 255, byte]))], np.uint64)
        bits = part.bits(code)[0]
        after = _with_first_byte(train, byte, scoring.DEPTH)
        assert bits == pytest.approx(after - before, abs=1e-6)
    every = np.array([int.from_bytes(b"\xffabc" + bytes([b]), "big") for b in range(256)], np.uint64)
    assert (2.0 ** part.bits(every)).sum() == pytest.approx(1.0, abs=1e-9)


def _with_first_byte(texts, byte, depth):
    """The weighted tree's log2 probability of whole texts and, if given, one more text's first byte."""
    counts = {}

    def count(coded, i):
        for k in range(8):
            prefix = (1 << k) | coded[i] >> (8 - k)
            bit = coded[i] >> (7 - k) & 1
            for d in range(depth + 1):
                counts.setdefault((coded[i - d : i], prefix), [0, 0])[bit] += 1

    gap = bytes([scoring.END]) * scoring.DEPTH
    for t in texts:
        coded = gap + t + bytes([scoring.END])
        for i in range(scoring.DEPTH, len(coded)):
            count(coded, i)
    if byte is not None:
        count(gap + bytes([byte]), scoring.DEPTH)
    return _weigh(counts, depth)


def _weigh(counts, depth):
    children = {}
    for ctx, prefix in counts:
        if ctx:
            children.setdefault((ctx[1:], prefix), []).append((ctx, prefix))

    def weighted(node):
        a, b = counts[node]
        own = (math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)) / math.log(2)
        if len(node[0]) == depth:
            return own
        below = sum(weighted(c) for c in children.get(node, []))
        high = max(own, below)
        return high + math.log2(2 ** (own - high) + 2 ** (below - high)) - 1

    return sum(weighted(n) for n in counts if not n[0])


@pytest.mark.parametrize(("frequent", "slice_nodes"), [(400_000, 6_000_000), (2, 40)])
def test_scores(spark, monkeypatch, frequent, slice_nodes):
    """Base scores by hand, and the same scores however the words and the tree are divided."""
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    monkeypatch.setattr(scoring, "SLICE_NODES", slice_nodes)
    train = ["The cat sat", "the dog", None, "The cat"]
    model = scoring.Model(documents(spark, train))
    docs = documents(spark, ["the cat flew", None, "THE  the\tthe", *EDGE[3:]])
    rows = scoring.score(docs, model).collect()
    counts = {"the": 3, "cat": 2, "sat": 1, "dog": 1, "": 4}
    n, v = 11, 5
    by_text = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id < 3}
    for i, text in enumerate(["the cat flew", "", "the the the"]):
        tokens = [*text.split(), ""]
        base = sum(math.log10((counts.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        r = by_text[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), n) and r.base_score == pytest.approx(base)
    assert len(rows) == docs.count() and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    total = _weigh_rows(train, "the cat flew")
    assert by_text[0].score == pytest.approx(total, rel=1e-9)


def _weigh_rows(train, text):
    """log10 of a text's probability under the frozen tree, bit by bit from the plain recursion."""
    counts = {}
    gap = bytes([scoring.END]) * scoring.DEPTH

    def places(t):
        coded = gap + t.lower().encode() + bytes([scoring.END])
        for i in range(scoring.DEPTH, len(coded)):
            for k in range(8):
                yield [(coded[i - d : i], (1 << k) | coded[i] >> (8 - k)) for d in range(scoring.DEPTH + 1)], coded[i] >> (7 - k) & 1

    for t in train:
        for path, bit in places(t or ""):
            for node in path:
                counts.setdefault(node, [0, 0])[bit] += 1
    before, total = {}, 0.0
    roots = {}
    for prefix in range(1, 256):
        roots[prefix] = {k: v for k, v in counts.items() if k[1] == prefix}
    for path, bit in places(text):
        prefix = path[0][1]
        if prefix not in before:
            before[prefix] = _weigh(roots[prefix], scoring.DEPTH)
        more = {k: list(v) for k, v in roots[prefix].items()}
        for node in path:
            more.setdefault(node, [0, 0])[bit] += 1
        total += _weigh(more, scoring.DEPTH) - before[prefix]
    return total * math.log10(2)


def test_scoring_without_training(spark):
    docs = documents(spark, EDGE)
    rows = scoring.score(docs, scoring.Model(docs.where("false"))).collect()
    assert len(rows) == len(EDGE) and all(r.n_known == 0 and r.bits_per_byte == pytest.approx(8.0) for r in rows)
    assert scoring.score(docs.where("false"), scoring.Model(docs)).count() == 0


def test_base_columns_are_those_of_sql(spark):
    """Counts and the word model's score against DuckDB, over the smallest tables."""
    import duckdb

    from codexmill.llm.queries import QUERIES

    data = "/root/testdata/sf0.001"
    ids = [r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM '{data}/documents.parquet'")
    con.execute("CREATE TABLE held (doc_id BIGINT, out BOOLEAN)")
    con.executemany("INSERT INTO held VALUES (?, ?)", [(i, zlib.crc32(str(i).encode()) % 5 == 1) for i in ids])
    want = con.execute(r"""
        WITH t AS (SELECT doc_id, unnest(list_append(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), '')) AS w FROM documents),
        c AS (SELECT w, count(*) AS c FROM t JOIN held USING (doc_id) WHERE NOT out GROUP BY w), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, out, count(*), count(c.c), any_value(n), sum(log10((coalesce(c.c, 0) + 0.5) / (n + 0.5 * (v + 1)))) FROM t JOIN held USING (doc_id) LEFT JOIN c USING (w), s GROUP BY ALL ORDER BY doc_id""").fetchall()
    got = QUERIES["op8_lm_scoring"](spark, data).orderBy("doc_id").collect()
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [x[:5] for x in want]
    assert all(abs(r.base_score - x[5]) < 1e-6 for r, x in zip(got, want, strict=True))
