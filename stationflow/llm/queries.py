"""Registered queries of the subpackage: the contract's digests, derived from
each operator's own output, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm import (chat, codes, decontaminate, jaccard, licenses, mixing, packing, pii, quality, repetition, resample, substring,
                             suffix)
from stationflow.sources.tables import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    v = decontaminate.verdicts(marked)
    return v.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate_az(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item, LEAST(LEN(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS t
  FROM (SELECT item, w, UNNEST(generate_series(1, GREATEST(1, LEN(w) - 12))) AS i FROM b WHERE LEN(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate_az(COALESCE(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT DISTINCT n FROM bw),
p AS (SELECT doc_id, w, n, UNNEST(generate_series(1, LEN(w) - n + 1)) AS i FROM d, k WHERE LEN(w) >= n),
m AS (SELECT p.doc_id, p.i, p.n, bw.item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM p) p JOIN bw USING (n, t)),
h AS (SELECT doc_id, COUNT(DISTINCT j) AS n_hit FROM (SELECT doc_id, UNNEST(generate_series(i, i + n - 1)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(DISTINCT item) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, LEN(d.w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       COALESCE(s, sha256('')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= LEN(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _folded(sql: str) -> str:
    """translate_az(x): A-Z of x lower-cased and nothing else."""
    out, at = "", 0
    while (i := sql.find("translate_az(", at)) >= 0:
        j, depth = i + len("translate_az("), 1
        k = j
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out += sql[at:i] + f"translate({sql[j:k - 1]}, '{_AZ}', '{_AZ.lower()}')"
        at = k
    return out + sql[at:]


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = substring.dedup_substrings(read_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS t
      FROM (SELECT doc_id, w, UNNEST(generate_series(1, LEN(w) - 49)) AS i FROM d WHERE LEN(w) >= 50)),
f AS (SELECT t, MIN(doc_id) AS first FROM p GROUP BY t),
g AS (SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + 49)))) AS gone
      FROM p JOIN f USING (t) WHERE first < doc_id GROUP BY doc_id)
SELECT d.doc_id, LEN(w)::BIGINT AS n_words, COALESCE(LEN(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
                   ELSE array_to_string(list_select(w, list_filter(generate_series(1, LEN(w)), lambda i: NOT list_contains(gone, i))), ' ') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repetition.quality_rules(read_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _repeats_sql(size: int, name: str) -> str:
    return rf"""
{name} AS (
  SELECT doc_id, COUNT(DISTINCT j) AS n FROM (
    SELECT doc_id, UNNEST(generate_series(i, i + {size - 1})) AS j FROM (
      SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, t) AS c FROM (
        SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS t
        FROM (SELECT doc_id, w, UNNEST(generate_series(1, LEN(w) - {size - 1})) AS i FROM d WHERE LEN(w) >= {size})))
    WHERE c > 1) GROUP BY doc_id)"""


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS n FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),{_repeats_sql(5, 'r5')},{_repeats_sql(10, 'r10')},{_repeats_sql(101, 'r101')},
a AS (
  SELECT d.doc_id, LEN(w)::BIGINT AS n_words, LENGTH(array_to_string(w, ''))::BIGINT AS word_chars,
         LENGTH(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, COALESCE(l.n, 0)::BIGINT AS n_dup_lines,
         COALESCE(r5.n, 0)::BIGINT AS n_repeat_words, COALESCE(r10.n, 0) AS n10, COALESCE(r101.n, 0) AS n101
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r5 USING (doc_id) LEFT JOIN r10 USING (doc_id) LEFT JOIN r101 USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n10 <= 0.15::DOUBLE * n_words AND n101 = 0 AS kept
FROM a
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    r = licenses.scan_licenses(docs, licenses.fit_licenses(docs))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    return r.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_license"), F.array_join(families, ",").alias("families"),
                    F.size(F.filter("licenses", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read_table(spark, sf_dir, "documents"))


OP6_SQL = _folded(r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate_az(COALESCE(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS t
  FROM (SELECT doc_id, w, UNNEST(generate_series(1, GREATEST(1, LEN(w) - 4))) AS i FROM d WHERE LEN(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, COUNT(*) AS o FROM s p JOIN s q USING (t) WHERE p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
r(a, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT r.a AS doc_id, COALESCE(ANY_VALUE(n.n), 0)::BIGINT AS n_shingles, MIN(r.c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
""")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    held = F.coalesce(held, F.lit(False))  # a row without an id is held out by nothing, nor does it have a label
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_label").alias("predicted"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]").alias("text")
    id_ = F.lit(-7).cast("long").alias("conv_id")
    for turn, role in enumerate(("user", "assistant")):
        rows = rows.union(spark.range(1).select(id_, F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), text))
    back = chat.read_back(chat.format_chat(chat.canonical_turns(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def _escaped_chars(c: str) -> str:
    """Length of c after escaping: one more for each backslash and control string."""
    out = f"LENGTH({c}) + LENGTH(regexp_replace({c}, '[^\\\\]', '', 'g'))"
    pattern = "|".join("".join("\\" + x if x in "|[]/" else x for x in s) for s in sorted(chat.CONTROL, key=len, reverse=True))
    return out + f" + LEN(regexp_extract_all({c}, '{pattern}'))"


OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, COUNT(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       SUM(CASE WHEN role = 'assistant' THEN LENGTH(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       SUM({_escaped_chars('role')} + {_escaped_chars('text')} + {len(chat.START + chat.MIDDLE + chat.END) + 1})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    r = pii.find_personal_data(docs, pii.fit_field(docs), redact=False)
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return r.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = suffix.dedup_bytes(read_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = codes.compress(read_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(book)).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """Lloyd's rounds as SQL: ``a<k>`` assigns parts, ``b<k>`` are the codebooks."""
    def nearest(k):
        return f"""
a{k} AS (
  SELECT v, p, ARG_MIN(e, ROW(d, e)) AS e, MIN(d) AS d FROM (
    SELECT x.v, x.p, b.e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM x JOIN b{k} b ON b.p = x.p) GROUP BY v, p)"""

    def moved(k):
        return f"""
m{k} AS (
  SELECT p, e, list(m ORDER BY j) AS c FROM (
    SELECT a.p, a.e, j, FLOOR_DIV(SUM(x.c[j]), COUNT(*)) AS m FROM a{k - 1} a JOIN x ON x.v = a.v AND x.p = a.p, (SELECT UNNEST(generate_series(1, (SELECT MAX(w) FROM n))) AS j)
    GROUP BY a.p, a.e, j) GROUP BY p, e),
b{k} AS (SELECT b.p, b.e, COALESCE(m.c, b.c) AS c FROM b{k - 1} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)"""

    steps = [nearest(0)] + [s for k in range(1, codes.ROUNDS + 1) for s in (moved(k), nearest(k))]
    sql = f"""
WITH k AS (
  SELECT ROW_NUMBER() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS v, vec_id, label,
         list_transform(embedding, lambda y: FLOOR({codes.SCALE} * y::DOUBLE)::BIGINT) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND LEN(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
n AS (SELECT LEN(c) // {codes.PARTS} AS w FROM k WHERE v = 0),
x AS (SELECT v, p, c[p * w + 1:(p + 1) * w] AS c FROM k, n, (SELECT UNNEST(generate_series(0, {codes.PARTS - 1})) AS p) WHERE LEN(c) = {codes.PARTS} * w),
b0 AS (SELECT p, v AS e, c FROM x WHERE v < {codes.ENTRIES}),{",".join(steps)},
r AS (SELECT v, string_agg(printf('%02x', e), '' ORDER BY p) AS code, SUM(d)::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY v),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM b{codes.ROUNDS})
SELECT k.vec_id, r.code, r.error, SUM(r.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, h.s AS codebooks_sha256
FROM k JOIN r USING (v), h
"""
    return sql.replace("FLOOR_DIV(SUM(x.c[j]), COUNT(*))", "(SUM(x.c[j]) - ((SUM(x.c[j]) % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*)")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_mixing, op3_substring_dedup, op4_quality_rules, op5_license_scan, op6_jaccard_join,
                                   op7_quality_classifier, op8_chat_formatting, op9_personal_data, op10_suffix_dedup, op11_best_fit_packing,
                                   op12_vector_codes, op13_importance_resampling)}
ORACLE = {"op1_decontamination": _folded(OP1_SQL), "op2_mixing": mixing.MIX_SQL.format(docs="documents"), "op3_substring_dedup": OP3_SQL,
          "op4_quality_rules": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op8_chat_formatting": OP8_SQL, "op12_vector_codes": _codes_sql()}
