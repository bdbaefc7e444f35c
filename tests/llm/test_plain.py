"""Results of the models and of page extraction against plain versions of them, and on the driver's tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from codexmill.llm import html, language, quality, queries

DATA = "/root/testdata"


# ------------------------------------------------------------------ language


def plain_grams(text):
    """Buckets of byte n-grams of a text in small letters, where all but letters and non-ASCII bytes is a blank."""
    low = [b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in b" " + text.encode()] + [32] * 4
    for n in language.ORDERS:
        for i in range(len(low) - 4):
            code = 0
            for b in low[i : i + n]:
                code = (code << 8 | b) & 0xFFFFFFFF
            yield ((code * 2654435761 + (n - 1) * 40503) % 2**32 * 2246822519 % 2**32) >> 16


def plain_language(train, text):
    languages = sorted({x for _, x in train})
    counts = {x: Counter() for x in languages}
    for t, x in train:
        counts[x].update(plain_grams(t))
    rate = {x: {b: n * 1e6 / counts[x].total() for b, n in counts[x].items()} for x in languages}
    blank = set(plain_grams("   "))
    code = language.codewords(len(languages))
    seen = set().union(*rate.values())
    margins = []
    for bit in range(code.shape[1]):
        side = {}
        for sign in (1, -1):
            own = [x for x, word in zip(languages, code, strict=True) if word[bit] == sign]
            mean = {b: sum(rate[x].get(b, 0) for x in own) / len(own) + language.SMOOTHING for b in seen}
            total = sum(mean.values()) + language.SMOOTHING * (language.BUCKETS - len(seen))
            side[sign] = lambda b, mean=mean, total=total: math.log(mean.get(b, language.SMOOTHING) / total)
        value = sum(side[1](b) - side[-1](b) for b in plain_grams(text) if b not in blank)
        margins.append(max(-language.MARGIN, min(language.MARGIN, value / language.REPEAT)))
    loss = [sum(math.log1p(math.exp(-m * int(w))) for m, w in zip(margins, word, strict=True)) for word in code]
    share = [math.exp(min(loss) - x) for x in loss]
    return languages[loss.index(min(loss))], 1 / sum(share)


def test_language_is_that_of_the_plain_version(spark):
    train = [("the cat and the dog", "en"), ("of the thing", "en"), ("der Hund und die Katze", "de"), ("die Sache über", "de"), ("el perro y la niña", "es"), ("les chats à la mer", "fr")]
    docs = spark.createDataFrame(train, "text string, lang string")
    asked = ["the dog", "die Katze", "la mer", "niña y perro", "zzz", "über the", "a"]
    got = {r.doc_id: r for r in language.predict(documents(spark, asked), language.fit(docs)).collect()}
    for i, text in enumerate(asked):
        name, score = plain_language(train, text)
        assert got[i].lang_pred == name and abs(got[i].score - score) < 1e-4, (text, name, score, got[i])


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang", F.length(F.regexp_replace("text", r"\P{L}", "")).alias("n"))
    found = queries.op9_language_id(spark, f"{DATA}/sf0.01").where("held_out").join(docs, "doc_id").where("n >= 40").collect()
    right = sum(r.lang_pred == r.lang for r in found) / len(found)
    print(f"language of {len(found)} held-out documents with 40 letters: {right:.4f}")
    assert right >= 0.97
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").select("doc_id", "quality").where("quality IN (0, 1)")
    rows = queries.op3_quality_classifier(spark, f"{DATA}/sf0.1").where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    print(f"quality of {len(rows)} held-out documents: {right:.4f}")
    assert right >= 0.97 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


# ------------------------------------------------------------------ quality


def plain_features(text):
    raw, out = text.encode(), set()
    for n in quality.ORDERS:
        for i in range(len(raw) - n + 1):
            code = int.from_bytes(raw[i : i + n], "big")
            out.add((code * 2654435761 + n * 40503) % 2**32 * 2246822519 % 2**32 >> 15)
    words = text.split()
    marks = "".join("1" if a == b else "0" for a, b in zip(words, words[1:], strict=False))
    for n in quality.MARK_ORDERS:
        for i in range(len(marks) - n + 1):
            out.add(quality.BUCKETS + (int("1" + marks[i : i + n], 2) * 2654435761 % 2**32 >> 20))
    return sorted(out)


def test_quality_features_and_ratios_are_the_plain_ones():
    texts = ["a good text", "Bad bad bad", "x", "ünï ünï"]
    found = quality.indicators([t.encode() for t in texts])
    assert [x.tolist() for x in found] == [plain_features(t) for t in texts]
    labels = np.array([1, 0, 1, 0])
    ratios = quality.log_count_ratios(found, labels)
    p, q = (Counter(b for t, y in zip(texts, labels, strict=True) if y == k for b in plain_features(t)) for k in (1, 0))
    sums = [quality.FEATURES + x.total() for x in (p, q)]
    for b in set(p) | set(q):
        assert abs(ratios[b] - (math.log((1 + p[b]) / sums[0]) - math.log((1 + q[b]) / sums[1]))) < 1e-12


def test_quality_scores_are_the_model_s(spark):
    texts = ["fine words in a row", "dull dull dull dull", "", "more fine words"] * 20
    docs = documents(spark, texts)
    model = quality.fit(docs, spark.createDataFrame([(i, int("dull" not in t)) for i, t in enumerate(texts)], "doc_id long, quality int"))
    for r in quality.predict(docs, model).collect():
        f = plain_features(texts[r.doc_id])
        margin = float(model.weights[f].sum()) / math.sqrt(max(float(model.squares[f].sum()), 1e-12)) + model.bias
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, model.slope * margin + model.shift))))) < 1e-4


# ------------------------------------------------------------------ pages


def plain_extraction(pages, first):
    """The query's texts, page by page with plain lists and sets: pages by id (host, html), and each host's reference page."""
    placed = {}
    for i, (host, page) in pages.items():
        reference, tree = (html.slots_of(html.parse(x)) for x in (pages[first[host]][1], page))

        def paths(slot, above=()):
            yield slot, (*above, slot.label)
            for kid in slot.kids:
                yield from paths(kid, (*above, slot.label))

        of = {id(x): path for x, path in paths(reference)}
        aligned = {id(y): of[id(x)] for x, y in html.align(reference, tree)}
        placed[i] = []

        def go(slot, above):
            if slot.nodes[0].tag not in html.RAW:
                path = aligned.get(id(slot), (*above, slot.label))
                placed[i].extend((path, html.own_text(n).replace(host, "\0")) for n in slot.nodes if html.own_text(n))
                for kid in slot.kids:
                    go(kid, path)

        go(tree, ())
    rows = []  # page, host, slot, text, what tells the page beside it
    for i, found in placed.items():
        for slot, text in set(found):
            rest = sorted({t for _, t in found} - {text}, key=lambda t: (-len(t), t))[:2]
            rows.append((i, pages[i][0], slot, text, tuple(rest)))

    def recurs(some):
        pairs = [(a[4], b[4]) for a in some for b in some if a[0] != b[0]]
        return len(some) > 1 and sum(x != y for x, y in pairs) >= html.DIFFERING * len(pairs)

    def groups(keys):
        out = defaultdict(list)
        for r in rows:
            out[tuple(r[k] for k in keys)].append(r)
        return out

    whole = set()
    by_text, pages_of = groups((2, 3)), {k[0]: len({r[0] for r in v}) for k, v in groups((2,)).items()}
    for slot, n in pages_of.items():
        texts = [(len(t), v) for (s, t), v in by_text.items() if s == slot]
        size = sum(c * len(v) for c, v in texts)
        share = sum(c * len(v) for c, v in texts if recurs(v)) / size
        rate = sum(c * len(v) * (len(v) - 1) for c, v in texts if recurs(v)) / size / max(1, n - 1)
        if share >= html.LEAST_SHARE and share >= html.RECURRING * (1 - max(0, 1 - rate) ** (n - 1)):
            whole.add(slot)
    single = set()
    on_host, slot_pages = groups((1, 2, 3)), {k: len({r[0] for r in v}) for k, v in groups((1, 2)).items()}
    for (host, slot), n in slot_pages.items():
        texts = {t: v for (h, s, t), v in on_host.items() if (h, s) == (host, slot)}
        if slot not in whole and sum(len(t) * len(v) for t, v in texts.items() if recurs(v)) <= html.COPIED * sum(len(t) * len(v) for t, v in texts.items()):
            single |= {(host, slot, t) for t, v in texts.items() if recurs(v) and len(v) >= html.SAME_SHARE * n}
    out = {}
    for i, (host, page) in pages.items():
        gone = {t for s, t in placed[i] if s in whole or (host, s, t) in single}
        told = {t for s, t in placed[i] if pages_of[s] >= html.TOLD_PAGES}
        tree, inside, outside = html.parse(page), [], []

        def visit(node, within):
            if not node.dropped:
                within = within or node.tag == "article"
                text = html.own_text(node).replace(host, "\0")
                if text and text not in gone:
                    (inside if within else outside).append(text)
                for kid in node.elements:
                    visit(kid, within)

        visit(tree, False)
        untold = [t for t in outside if t not in told]
        if inside and sum(map(len, inside)) >= html.REGION_PART * sum(map(len, untold)):
            gone |= set(untold)
        out[i] = html.text_of(tree, {id(n) for n in html.walk(tree) if html.own_text(n).replace(host, "\0") in gone})
    return out


def test_texts_are_those_of_the_plain_extraction(spark):
    pages = {}
    for i in range(60):
        extra = f"<section><h2>More {i % 3} of these</h2><p>Shared words {i % 7} apart</p></section>" if i % 2 else ""
        pages[i] = ("a.example", f"<div class=m{i}><a>Home</a><a>Item {i % 4}</a></div><article><h1>Title {i} own</h1><p>Body of {i} with words</p><p>Passage {i % 9} repeats</p>{extra}</article><div>Foot of a.example</div><div class=q>Loose {i} text</div>")
    for i in range(60, 90):
        pages[i] = ("b.example", f"<ul>{'<li>x' * (i % 5)}<li>Line {i % 2}</ul><div><p>Text {i // 3} of b</p></div><p>Ad {i % 6}</p>")
    for i in range(90, 100):
        pages[i] = (f"c{i}.example", f"<article><h1>Only {i} here</h1><p>Share me</p></article><div>Foot of c{i}.example</div>")
    rows = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, (h, x) in pages.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(rows).collect()}
    # the plain version takes the same page of each host as its reference
    first = {r.h: r.k for r in spark.createDataFrame([(i, h, x) for i, (h, x) in pages.items()], "k int, h string, html string").groupBy("h").agg(F.min_by("k", F.xxhash64("html")).alias("k")).collect()}
    assert got == plain_extraction(pages, first)
    assert all("Home" not in x and "Foot" not in x for x in got.values()) and all(f"Body of {i} with words" in got[i] for i in range(60))


def test_equally_near_languages(spark):
    """Languages learned from the same texts are equally near: the first in order is taken, and flagged."""
    rows = [(t, lang) for lang in ("zz", "aa") for t in ("some words", "and others")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    for r in language.predict(documents(spark, ["some others", "unheard of"]), model).collect():
        assert r.lang_pred == "aa" and abs(r.score - 0.5) < 1e-9 and r.ambiguous
