"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locspark.llm import audio_fingerprint, chat_format, decontaminate, filter_audit, license_scan, lm_scoring, ngram_join, piece_encoding, quality_classifier, spelling, substring_trees, suffix_dedup, warc

PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept", "kept_text", "text_hash")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_fingerprint.align_recordings(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "named_struct('role', '{}', 'content', '</s>[INST] ok [/INST]')"
    extra = spark.range(1).selectExpr("cast(-7 as bigint) as conv_id", f"array({said.format('user')}, {said.format('assistant')}) as messages")
    return chat_format.chat_digests([table(spark, sf_dir, "conversations"), extra])


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode_pieces(table(spark, sf_dir, "documents"), piece_model_path(), keep=False).drop("ids", "decoded")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_trees.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text", "n_spans")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_lm_scoring, op3_media_columns, op4_chat_formatting, op5_quality_classifier, op6_piece_encoding, op7_decontamination, op8_warc, op9_ngram_join, op10_license_scan, op11_spelling_variants, op12_filter_audit, op13_substring_dedup)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w,
  list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda a, b: xor(CAST(floor(xor(a, b) / 2) AS BIGINT), CASE WHEN xor(a, b) % 2 = 1 THEN 3988292384 ELSE 0 END)) AS crc FROM documents),
m AS (SELECT *, (4294967295 - crc) % 10 = 0 AS held_out FROM d),
t AS (SELECT doc_id, held_out, unnest(list_transform(w, lambda x: 'w' || x) || ['e']) AS token, unnest(range(1, len(w) + 2)) AS i, unnest(['s'] || list_transform(w, lambda x: 'w' || x)) AS before,
  unnest((['0', 's'] || list_transform(w, lambda x: 'w' || x))[1:len(w) + 1]) AS before2 FROM m),
c1 AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
c2 AS (SELECT before, token, count(*) AS c FROM t WHERE NOT held_out GROUP BY ALL),
c3 AS (SELECT before2, before, token, count(*) AS c FROM t WHERE NOT held_out AND before2 <> '0' GROUP BY ALL),
n AS (SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS known, (SELECT count(*) FROM m WHERE NOT held_out) AS starts FROM c1),
p AS (SELECT t.doc_id, t.held_out, coalesce(c1.c, 0) AS c, (coalesce(c1.c, 0) + 0.1::DOUBLE) / (n.total + 0.1::DOUBLE * (n.known + 1)) AS p,
    coalesce(c2.c, 0) AS cc, CASE WHEN t.before = 's' THEN n.starts ELSE coalesce(h.c, 0) END AS h, coalesce(c3.c, 0) AS ccc, coalesce(k.c, 0) AS hh, n.total
  FROM t CROSS JOIN n LEFT JOIN c1 ON t.token = c1.token LEFT JOIN c1 h ON t.before = h.token LEFT JOIN c2 ON t.before = c2.before AND t.token = c2.token
  LEFT JOIN c2 k ON t.before2 = k.before AND t.before = k.token LEFT JOIN c3 ON t.before2 = c3.before2 AND t.before = c3.before AND t.token = c3.token),
q AS (SELECT *, CASE WHEN h > 0 THEN least(1.0::DOUBLE, {lm_scoring.LEFT_A}::DOUBLE * pow(h::DOUBLE, -{lm_scoring.LEFT_B}::DOUBLE)) ELSE 1.0::DOUBLE END AS l,
  CASE WHEN hh > 0 THEN least(1.0::DOUBLE, {lm_scoring.LEFT_A}::DOUBLE * pow(hh::DOUBLE, -{lm_scoring.LEFT_B}::DOUBLE)) ELSE 1.0::DOUBLE END AS ll FROM p)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(total) AS train_tokens,
  round(sum(log10(p)), 6) AS base_score, round(sum(log10((1 - ll) * ccc / greatest(hh, 1) + ll * ((1 - l) * cc / greatest(h, 1) + l * p))), 6) AS score
FROM q GROUP BY doc_id"""

_OP4 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '([<\[]/?)(\\*)(s>|INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[]/?)(\\*)(s>|INST\])', '\1\\\2\3', 'g')) + 20 AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '00' AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS response,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((
    (instr('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS INT), 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, CAST(5 * i // 4 + 2 AS INT), 1)) - 1) // CAST(pow(2, 3 - 5 * i % 4) AS BIGINT)) % 32 + 1 AS INT), 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM q"""

_OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * c >= 75 * (na + nb - c) UNION SELECT b, a FROM o WHERE 100 * c >= 75 * (na + nb - c)),
r AS (SELECT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(min(r.other), s.doc_id) AS component_id FROM s LEFT JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.s"""



def _crc_step(c: int) -> int:
    """Four steps of the checksum's division."""
    for _ in range(4):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


# crc32 of `<doc_id>:<run>`, half a byte a step; the runs' letters have code points under 256
_OP11 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS k FROM d GROUP BY ALL),
y AS (SELECT run, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c) % 16, unicode(c) // 16] ELSE [3, 12, unicode(c) % 16, unicode(c) // 16 - 4] END)) AS half FROM r),
h AS (SELECT run, k, 4294967295 - list_reduce([4294967295] || CAST(half AS BIGINT[]), lambda a, z: xor(a // 16, {[_crc_step(c) for c in range(16)]}[xor(a, z) % 16 + 1])) AS h FROM y),
v AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v GROUP BY word HAVING length(word) >= 5 AND sum(k) >= 3),
s AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, z.word AS other, z.n FROM s a JOIN s z ON a.rest = z.rest AND a.i = z.i AND a.word <> z.word
  UNION SELECT a.word, z.word, z.n FROM s a JOIN w z ON a.rest = z.word UNION SELECT z.word, a.word, a.n FROM s a JOIN w z ON a.rest = z.word),
g AS (SELECT word, count(*) AS n_near, max(n) AS m FROM e GROUP BY word), f AS (SELECT g.word, n_near, m, min(encode(other)) AS best FROM g JOIN e ON g.word = e.word AND e.n = g.m GROUP BY ALL),
o AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN decode(best) END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN f ON w.word = f.word),
c AS (SELECT word, word AS at, 0 AS steps FROM o UNION ALL SELECT c.word, o.form, steps + 1 FROM c JOIN o ON o.word = c.at WHERE o.form IS NOT NULL)
SELECT o.word, o.form, arg_max(c.at, c.steps) AS root, o.n, o.n_near, o.form_n FROM o JOIN c ON o.word = c.word GROUP BY ALL"""

_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS x FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
m AS (SELECT row_number() OVER () AS row, part, good, toxic, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END) || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS fails FROM f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l), o AS (SELECT a.l || b.l || c.l || e.l || f.l AS o FROM l a, l b, l c, l e, l f WHERE len(list_distinct([a.l, b.l, c.l, e.l, f.l])) = 5),
p AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL), q AS (SELECT p.*, o, s, substr(o, CAST(s AS BIGINT), 1) AS f, coalesce(list_min(list_filter(range(1, 6), lambda k: contains(fails, substr(o, k, 1)))), 6) AS first FROM p, o, range(1, 6) r(s)),
z AS (SELECT part, o AS filter_order, CAST(s AS INT) AS step, f, sum(n) FILTER (first > s) AS kept, sum(n) FILTER (first = s) AS removed, sum(n) FILTER (first < s AND contains(fails, f)) AS redundant, sum(n) FILTER (fails = f) AS unique_fails,
  sum(n) FILTER (first = s AND good) AS good_lost, sum(n) FILTER (first = s AND toxic) AS toxic_lost FROM q GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM z"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT row, doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
x AS (SELECT row, i, doc_id > min(doc_id) OVER (PARTITION BY g) OR i > min(i) OVER (PARTITION BY g, row) AS again FROM s),
c AS (SELECT DISTINCT row, unnest(range(i, i + 20)) AS i FROM x WHERE again), k AS (SELECT row, i, word FROM (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN c USING (row, i)),
j AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN j USING (row)"""

SQL = {"op2_lm_scoring": _OP2, "op4_chat_formatting": _OP4, "op8_warc": _OP8, "op9_ngram_join": _OP9, "op11_spelling_variants": _OP11, "op12_filter_audit": _OP12, "op13_substring_dedup": _OP13}
