"""Near-duplicates, decontamination and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from helpers import EDGE, LONG, documents
from pyspark.sql import functions as F

from codexmill.llm import ann, components, decontamination, minhash


def shingles(text):
    w = (text or "").encode().translate(minhash._LOWER).split()
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    """For each row the smallest id reachable over links, and whether links connect it to any other row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for k in range(6):
        base = [f"b{k}x{rng.randrange(500)}" for _ in range(rng.choice([6, 40, 120]))]
        texts += family(rng, base, 25, 4)
    texts += ["Copy of One two three four five six"] * 40 + ["copy OF one two\tthree four five six", "short one", "Short One", "a b c d", *EDGE]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("block", "leaders", "outside"), [(192, 16, 40), (7, 2, 40), (5, 0, 0)])
def test_components_are_those_of_all_links(spark, monkeypatch, block, leaders, outside):
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", block)
    monkeypatch.setattr(minhash, "OUTSIDE_BLOCKS", outside)
    monkeypatch.setattr(minhash, "LEADERS", leaders)
    docs = documents(spark, corpus(3))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.near_duplicates(docs).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows, 85), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_deduplicate_keeps_one_of_each_group(spark):
    docs = documents(spark, ["one two three four five six seven"] * 30 + [None, "", "other words here that stand alone now"])
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 30, 31, 32]
    assert minhash.near_duplicates(docs.where("false")).count() == 0 and minhash.deduplicate(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=79)


def test_deduplicate_decides_by_row(spark):
    """Repeated ids, repeated rows and rows without an id: one row of each group, whichever columns it has."""
    a, b, c = "one two three four five six seven", "One two three four FIVE six  seven", "eight nine ten eleven twelve"
    docs = documents(spark, [(3, a), (3, a), (3, c), (None, a), (4, b), (None, c), (None, "x y"), (None, "x y"), (7, ""), (7, ""), (None, None)])
    docs = docs.withColumns({x: F.lit(1) for x in ("root", "class", "h1", "h2", "key", "__n0")})
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, a), (3, c), (None, "x y"), (7, ""), (7, ""), (None, None)], key=repr)


def test_links_at_the_threshold_in_a_crowd_cut_by_further_bands(spark, monkeypatch):
    """Texts that share a passage crowd its buckets; pairs of exactly 0.85 among them are found, those just below aren't links."""
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(minhash, "OUTSIDE_BLOCKS", 1)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(60):
        own = passage + [f"w{rng.randrange(10**9)}" for _ in range(44)]  # 100 shingles
        texts += [" ".join(own), " ".join(own[: 89 if k % 2 else 88])]  # 85 or 84 of them
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert found == {2 * k + j: 2 * k + (0 if k % 2 else j) for k in range(60) for j in (0, 1)}
    assert found == {i: c for i, _, c in brute_components(list(enumerate(texts)), 85)}


def test_a_mass_of_copies_is_compared_in_proportion(spark, monkeypatch):
    """Blocks tie a large group together, and only what stays outside of it meets the rest."""
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 50)
    compared = []
    plain = minhash._connected
    monkeypatch.setattr(minhash, "_connected", lambda rows, compare, bins=None, finer=None: compared.append(1) or plain(rows, compare, bins, finer))
    rng = random.Random(9)
    base = [f"b{rng.randrange(900)}" for _ in range(150)]
    texts = family(rng, base, 400, 3) + ["another text of its own words altogether here"]
    found = minhash.near_duplicates(documents(spark, texts)).collect()
    rows = [(i, t) for i, t in enumerate(texts)]
    assert {r.doc_id: r.component_id for r in found} == {i: c for i, _, c in brute_components(rows, 85)} and len(compared) == 2


def test_sql_of_components(spark):
    """The SQL on a small corpus with every kind of edge, which gives a row per document id."""
    import duckdb

    from codexmill.llm.queries import ORACLES

    docs = documents(spark, [t for t in corpus(4) if not isinstance(t, tuple)])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op5_near_duplicates']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in minhash.near_duplicates(docs).select(*columns).orderBy("doc_id").collect()] == want


def test_pruning_drops_a_linked_pair_with_the_chosen_probability():
    from math import comb

    keep = minhash.fewest_matches(0.85)
    assert list(keep) == [32, 64, 96, 128]
    for n, m in keep.items():
        assert sum(comb(n, k) * 0.85**k * 0.15 ** (n - k) for k in range(m)) < 1e-4


def test_connected_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


# ------------------------------------------------------------------ decontamination


def brute_hits(rows, items, n, slop=0):
    out = []
    for doc_id, text in rows:
        words = decontamination.words((text or "").encode())
        hit, found = set(), set()
        for item, t in items:
            for w in decontamination.windows_of(decontamination.words((t or "").encode()), n):
                for i in range(len(words)):
                    if slop:
                        for j in range(i + 1, min(len(words), i + len(w) + slop) + 1):
                            part = words[i:j]
                            if all(part.count(x) >= w.count(x) for x in w):
                                hit |= set(range(i, j))
                                found |= {item} - {None}
                                break
                    elif tuple(words[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        found |= {item} - {None}
        out.append((doc_id, len(words), len(hit), sorted(map(str, found))))
    return out


def as_sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, list) else (False, x) for x in r))


@pytest.mark.parametrize(("segment", "most", "block"), [(24 << 20, 1 << 16, 8 << 20), (200, 100, 60), (1 << 20, 2, 60)])
def test_phrases_are_those_of_brute_force(spark, monkeypatch, segment, most, block):
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(decontamination, "SEGMENT_DOCS", most)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["The", "cat", "sat-on", "MAT", "é", "x"]) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", "...", (None, "the cat sat"), (3, "cat mat")]
    items = [(0, "the cat sat on mat"), (1, "é x the"), (2, "MAT"), (3, None), (4, ""), (None, "x x é"), (10, "the cat sat on mat"), (5, "zebra cat"), (0, "x x x x")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    index = decontamination.build_index(docs)
    assert index.where("term IS NULL").groupBy("segment").count().agg(F.max("count")).first()[0] <= most
    got = decontamination.match(index, tests, n=3).collect()
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], items, 3)
    assert as_sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == as_sorted(want)


def test_proximity_covers_every_brute_force_run(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(30)]
    items = [(0, "a b c"), (1, "d d e"), (2, "h a")]
    docs = documents(spark, texts)
    got = decontamination.match(decontamination.build_index(docs), spark.createDataFrame(items, "item_id long, text string"), n=3, slop=2).collect()
    want = {r[0]: r[3] for r in brute_hits([(r.doc_id, r.text) for r in docs.collect()], items, 3, slop=2)}
    assert {r.doc_id: list(r["items"]) for r in got} == want


def test_decontamination_edges(spark):
    tests = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = documents(spark, ["one two three four", LONG + "one two three four", "clean text", None])
    kept = decontamination.drop_contaminated(docs, tests)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    same = documents(spark, [(None, "one two three four"), (None, "clean text"), (9, "one two three four"), (9, "more clean text"), (None, None)]).withColumns({x: F.lit(1) for x in ("h1", "h2", "base", "segment", "n_hit")})
    assert sorted((str(r.doc_id), str(r.text)) for r in decontamination.drop_contaminated(same, tests).collect()) == [("9", "more clean text"), ("None", "None"), ("None", "clean text")]
    index = decontamination.build_index(docs)
    assert all(r.n_hit == 0 for r in decontamination.match(index, tests.where("false")).collect())
    blank = decontamination.match(decontamination.build_index(documents(spark, [None, "", "..."] * 40)), tests).collect()
    assert len(blank) == 120 and all((r.n_words, r.n_hit, list(r["items"])) == (0, 0, []) for r in blank)
    assert decontamination.match(decontamination.build_index(docs.where("false")), tests).count() == 0


# ------------------------------------------------------------------ nearest neighbours


def clustered(seed, n, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width))
    return (centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, width))).astype(np.float32)


def brute_nearest(rows, k):
    out = {}
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    for q in np.unique(ids[ids % 50 == 0]):
        for v in {tuple(x[i]) for i in np.flatnonzero(ids == q)}:
            s = ann.cosines(np.array(v), x)
            order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
            out[int(q)] = [(int(ids[i]), s[i]) for i in order]
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_ROWS", 16)
    monkeypatch.setattr(ann, "REGION_ROWS", 100)
    monkeypatch.setattr(ann, "CELLS_A_ROW", 0.005)  # few cells, so that some hold several parts
    x = clustered(1, 3000)
    x[500:900] = x[0]  # a third of some tables is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(None, x[0].tolist()), (5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, []), (5250, [1.0, 2.0]), (5300, [float("inf")] + [1.0] * 15)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    got = {}
    for r in ann.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(rows, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 5 * len(want)
    assert got[0] == want[0] and got[600] == want[600]  # ties of equal vectors go to the smaller ids
    scores = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(abs(scores[q, i] - s) < 1e-12 for q, v in got.items() for i, s in v if (q, i) in scores)


def test_recall_and_visited_share_on_the_tables(spark):
    """On the driver's vectors, which lie almost at random, and on clustered ones, of which few are visited."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    far = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(7, 6000, 32))], "vec_id long, embedding array<float>")
    for name, vectors, most in (("sf0.1", table, 0.8), ("clustered", far, 0.2)):
        rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
        want = brute_nearest(rows, 5)
        (index,) = ann.indexes(vectors, F.col("vec_id") % 50 == 0, 5)
        got = {}
        for r in index.search().collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recall = sum(len(got[q] & {i for i, _ in want[q]}) for q in want) / (5 * len(want))
        print(f"{name}: recall {recall:.3f}, visited share {index.wanted / index.total:.3f} of {index.total}")
        assert recall >= 0.9 and index.wanted < most * index.total


def test_very_large_and_small_components(spark):
    rows = [(0, [1e200, 2e200, 1e-200]), (1, [2e-200, 4e-200, 0.0]), (2, [1e-310, 0.0, 0.0]), (3, [-1e300, 1e300, 1e300]), (4, [0.0, 5e-324, 0.0]), (5, [1e200, 2e200, 1e-200])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.score for r in ann.search(table, F.col("vec_id") == 0, k=9).collect()}
    assert set(found) == {1, 2, 3, 4, 5} and all(np.isfinite(x) for x in found.values())
    assert abs(found[1] - 1) < 1e-15 and abs(found[5] - 1) < 1e-15 and abs(found[2] - 5**-0.5) < 1e-15 and abs(found[3] - 15**-0.5) < 1e-15 and abs(found[4] - 2 * 5**-0.5) < 1e-15


def test_vectors_of_several_lengths(spark):
    rows = [(k, [1.0, float(k)]) for k in range(6)] + [(k, [1.0, float(k), 1.0]) for k in range(50, 56)] + [(100, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({x: F.lit("x") for x in ("id", "vector", "name", "cell", "region", "part", "ids", "asks")})
    found = {}
    for r in ann.search(table, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {0: [1, 2, 3], 50: [51, 52, 53]}


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(table, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.search(table.where("vec_id = 0"), F.lit(True)).count() == 0 and ann.search(table.where("false"), F.lit(True)).count() == 0
    assert ann.search(table, F.lit(False)).count() == 0


def test_ties_between_different_vectors_of_one_direction(spark):
    """Multiples of one vector have one cosine: the smallest ids come first, however many there are."""
    rows = [(i, [3.0 * (i + 1), 4.0 * (i + 1)], 0) for i in range(40)] + [(100 + i, [float(i % 7) - 3, 1.0], 0) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(table, F.col("vec_id") < 3, k=5).collect())
    for q in range(3):
        scores = {i: float(ann.cosines(np.array(rows[q][1]), np.array([v]))[0]) for i, v, _ in rows if i != q}
        assert [v for a, _, v in got if a == q] == sorted(scores, key=lambda i: (-scores[i], i))[:5]
    assert [v for a, _, v in got if a == 0] == [1, 2, 3, 4, 5]


def test_probes_do_not_grow_with_the_cells(spark):
    """A query's rows carry a radius; the regions that it names test their own cells."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(400)]
    (index,) = ann.indexes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 50 == 0)
    out = next(ann._probe(index.model, index.counts, index.regions, index.wanted)(iter(index.entries.select("name", "vector").toArrow().to_batches())))
    assert out.schema.names == ["name", "vector", "region", "radius"]
    vector, region, radius = out.column("vector")[0].as_py(), out.column("region").to_numpy(), out.column("radius")[0].as_py()
    first, second = index.model.value.distances(np.array(vector))
    visited = np.array(ann.visit(first, second, index.counts.value, index.wanted))
    assert ann.sums(first, second, visited).max() == radius and set(index.regions.value[0][visited]) <= set(region.tolist())


def test_cells_are_visited_in_order_of_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(9)
    order = ann.visit(a, b, np.ones(63, int), 63)
    assert len(order) == 63 and np.allclose(np.sort((a[:, None] + b).ravel()), [a[c // 9] + b[c % 9] for c in order])
