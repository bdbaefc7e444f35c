"""The queries over the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, common, decontamination, html, language, minhash, packing, pii, quality, repair, scoring, token_output, toxicity

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontamination.build_index(_table(spark, sf_dir, "documents"))
    found = decontamination.match(index, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"),
    )


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token-output")
    token_output.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return token_output.index(spark, path)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    known = labels.where(common.outside_fold("doc_id", 5, 0))
    model = quality.fit(docs.where(common.outside_fold("doc_id", 5, 0)), known)
    scored = quality.predict(docs, model)
    return scored.select("doc_id", common.is_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents")).drop("scores")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = scoring.Model(docs.where(common.outside_fold("doc_id", 5, 1)))
    scored = scoring.score(docs, model)
    return scored.select("doc_id", common.is_fold("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(common.outside_fold("doc_id", 4, 2)))
    found = language.predict(docs, model)
    return found.select("doc_id", common.is_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1, with_ids=False)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(_table(spark, sf_dir, "conversations")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    known = labels.where(common.outside_fold("doc_id", 4, 2))
    model = toxicity.fit(docs.where(common.outside_fold("doc_id", 4, 2)), known)
    scored = toxicity.predict(docs, model)
    return scored.select("doc_id", common.is_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.with_label_errors(codes.encode(_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_output": op2_token_output,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_extraction": op4_html_extraction,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_pii": op6_pii,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_toxicity": op12_toxicity,
    "op13_vector_codes": op13_vector_codes,
}

_OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT doc_id, CASE WHEN ws IS NULL THEN 0 ELSE len(ws) END AS n_words, ws FROM w),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT least(len(ws), 13) AS k FROM iw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 12))) AS i FROM iw WHERE len(ws) > 0)),
grams AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, sizes WHERE len(ws) >= k)),
occ AS (SELECT doc_id, grams.k, i, item_id FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n_words AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""

_OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM both_ JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * both_.n >= 85 * (p.n + q.n - both_.n)),
step AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, step.y FROM reach JOIN step ON step.x = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT least.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, component_id, least.doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""

def _op11_sql() -> str:
    """A dynamic programme over the rows: the best (cost, audit, lines) of each place in the pattern. Two inserts in a row never pay."""
    places = ("zero", "sys", "usr", "ast")

    def go(origin: str, cost: str, mark: str, line: str | None, when: str = "true") -> str:
        lines = f"list_append({origin}.t, {line})" if line else f"{origin}.t"
        return f"CASE WHEN {origin} IS NOT NULL AND {when} THEN {{'c': {origin}.c + {cost}, 'a': {origin}.a || '{mark}', 't': {lines}}} END"

    empty = {name: f"concat('{name}', ':')" for name in ("user", "assistant")}
    with_insert = {
        "zero": "zero", "sys": "sys",
        "usr": f"list_min([usr, {', '.join(go(x, '5', 'I', empty['user']) for x in ('zero', 'sys', 'ast'))}])",
        "ast": f"list_min([ast, {go('usr', '5', 'I', empty['assistant'])}])",
    }
    fine, own = "fault NOT IN ('blank', 'duplicate')", "concat(role, ':', text)"
    kept = lambda x, initial: go(x, "charge", "K", own, f"{fine} AND left(role, 1) = '{initial}'")
    turned = lambda x, name: go(x, "1 + charge", "R", f"concat('{name}', ':', text)", fine)
    dropped = lambda x: go(x, "2", "D", None)
    after = {
        "zero": f"list_min([{dropped('zero')}])",
        "sys": f"list_min([{dropped('sys')}, {kept('zero', 's')}])",
        "usr": f"list_min([{dropped('usr')}, {', '.join(kept(x, 'u') + ', ' + turned(x, 'user') for x in ('zero', 'sys', 'ast'))}])",
        "ast": f"list_min([{dropped('ast')}, {kept('usr', 'a')}, {turned('usr', 'assistant')}])",
    }
    start = "{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"
    none = f"CASE WHEN false THEN {start} END"
    wide = ", ".join(f"{with_insert[x]} AS {x}" for x in places)
    return rf"""
WITH RECURSIVE bits AS (SELECT n, 0 AS k, n AS c FROM range(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8),
source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
kinds AS (SELECT source.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(key, '')]), lambda c, b: xor(tab[CAST(xor(c, b) % 256 AS INT) + 1], c >> 8)), 4294967295) % 20 AS kind FROM source, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS earlier, right(rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 1) AS final FROM damaged),
judged AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN earlier > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, earlier)),
lattice AS (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS charge FROM judged),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {start} AS zero, {none} AS sys, {none} AS usr, {none} AS ast FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, {', '.join(f'{after[x]} AS {x}' for x in places)}
  FROM (SELECT w.conv_id, l.i, l.role, l.text, l.fault, l.charge, {wide} FROM walk w JOIN lattice l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1)),
ended AS (SELECT conv_id, list_min([zero, CASE WHEN usr IS NULL THEN ast ELSE list_min([ast, {go('usr', '5', 'I', empty['assistant'])}]) END]) AS best
  FROM (SELECT conv_id, i, {wide} FROM walk) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _op13_sql(rounds: int = codes.ROUNDS) -> str:
    """Every distance of every round, for vectors of one length, a multiple of eight."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, p, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (SELECT v.rid, v.p, b.e, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v.q, b.q)]) AS d FROM parts v JOIN b{r} b ON b.p = v.p) GROUP BY rid, p)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT v.p, a.e, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM parts v JOIN a{r} a ON a.rid = v.rid AND a.p = v.p) GROUP BY ALL)""")
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.q, b.q) AS q FROM b{r} b LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM m{r} GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * {codes.SCALE}) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, p, q[p * len(q) // {codes.PARTS} + 1 : (p + 1) * len(q) // {codes.PARTS}] AS q FROM kept, range({codes.PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, rid AS e, q FROM parts WHERE rid < {codes.ENTRIES}),
{", ".join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) AS h FROM b{rounds}),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN coded USING (rid) GROUP BY label)
SELECT kept.vec_id, code, error, label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (rid) JOIN sums ON sums.label IS NOT DISTINCT FROM kept.label, books
"""


ORACLES: dict[str, str] = {
    "op1_decontamination": _OP1_SQL,
    "op5_near_duplicates": _OP5_SQL,
    "op11_conversation_repair": _op11_sql(),
    "op13_vector_codes": _op13_sql(),
}
