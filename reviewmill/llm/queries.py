"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from reviewmill.llm import bpe, chat, counts, exact, licenses, middle, mixing, ngrams, phrases, projections, repair, secrets, toxicity

QUERIES, ORACLES = {}, {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PROBE_TEXT = "</s>[INST] ok [/INST]"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chat_formatting(spark, d):
    probe = spark.createDataFrame(
        [(-1, 0, "user", PROBE_TEXT), (-1, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string"
    )
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.prefix_examples(rows))


ORACLES["op1_chat_formatting"] = r"""
WITH talk AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
lengths AS (
  SELECT *, length('[INST]  [/INST]</s>')
    + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS piece,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last
  FROM talk),
ends AS (SELECT *, 3 + sum(piece) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM lengths)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM ends GROUP BY conv_id"""


@query
def op2_exact_dedup(spark, d):
    return exact.exact_groups(read(spark, d, "documents"))


ORACLES["op2_exact_dedup"] = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY t)"""


@query
def op3_bpe_roundtrip(spark, d):
    return bpe.verify_round_trip(read(spark, d, "documents"), BYTE_BPE)


@query
def op4_token_counts(spark, d):
    return counts.count_tokens(read(spark, d, "documents"), BYTE_BPE)


@query
def op5_embedding_near_dedup(spark, d):
    return projections.near_vectors(read(spark, d, "embeddings"))


@query
def op6_ngram_jaccard_join(spark, d):
    return ngrams.jaccard_groups(read(spark, d, "documents"), ngrams.Join(words=3, percent=90))


@query
def op8_license_scans(spark, d):
    return licenses.scan_licenses(read(spark, d, "documents"))


@query
def op9_source_mixing(spark, d):
    return mixing.mix_report(read(spark, d, "documents"))


@query
def op7_toxicity_chain(spark, d):
    docs = read(spark, d, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_chain(docs, read(spark, d, "labels")))


@query
def op10_secret_scan(spark, d):
    return secrets.scan_secrets(read(spark, d, "documents"))


@query
def op11_fill_in_middle(spark, d):
    return middle.middle_report(read(spark, d, "documents"))


ORACLES["op11_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS hs FROM units),
cuts AS (
  SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain'
      WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""


@query
def op12_benchmark_decontamination(spark, d):
    return phrases.decontamination_report(read(spark, d, "documents"), read(spark, d, "benchmark"))


ORACLES["op12_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
sized AS (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
starts AS (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized),
phrases AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM starts),
places AS (
  SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM phrases) WHERE len(w) >= k),
grams AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM places),
hits AS (SELECT DISTINCT r, k, i, item_id FROM grams JOIN phrases USING (k, g)),
words AS (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hits),
n_hits AS (SELECT r, count(*) AS n_hit FROM words GROUP BY r),
named AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM named GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hits USING (r) LEFT JOIN items USING (r)"""


@query
def op13_conversation_repair(spark, d):
    return repair.repair_report(read(spark, d, "conversations"))


# Plain dynamic programming, a row a step; crc32 is spelled out: each byte, then eight shifts.
ORACLES["op13_conversation_repair"] = r"""
WITH RECURSIVE spaced AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(
    flatten([[CAST(unicode(k[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, length(k) + 1)]),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END,
    CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS code
  FROM spaced),
damaged AS (
  SELECT c, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE code <> 0),
counted AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged),
faulty AS (
  SELECT *, row_number() OVER o AS p, role[1] AS initial, lag(role[1]) OVER o AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM counted WINDOW o AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, nth)),
facts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY c),
moves(i, f, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ins(f, t, cost, x, made) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
  (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
ops AS (
  SELECT c, p, s.f, s.f AS t, 3 AS cost, 'D' AS x, []::VARCHAR[] AS made FROM faulty, (SELECT unnest([0, 1, 2, 3]) AS f) s
  UNION ALL SELECT c, p, f, t, CASE WHEN fault = '' THEN 0 ELSE 1 END, 'K', [role || ':' || text]
  FROM faulty JOIN moves ON i = initial WHERE fault IN ('', 'truncated')
  UNION ALL SELECT c, p, f, t, CASE WHEN fault = '' THEN 2 ELSE 3 END, 'R', [CASE i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM faulty JOIN moves ON i IN ('u', 'a') WHERE fault IN ('', 'truncated')),
steps AS (
  SELECT c, p, ins.f, ops.t, ins.cost + ops.cost AS cost, ins.x || ops.x AS x, list_concat(ins.made, ops.made) AS made
  FROM ops JOIN ins ON ins.t = ops.f),
ways AS (
  SELECT c, CAST(0 AS BIGINT) AS p, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS made FROM facts
  UNION ALL
  SELECT c, p, s, cost, audit, made FROM (
    SELECT w.c, e.p, e.t AS s, w.cost + e.cost AS cost, w.audit || e.x AS audit, list_concat(w.made, e.made) AS made,
      row_number() OVER (PARTITION BY w.c, e.t ORDER BY w.cost + e.cost, w.audit || e.x) AS best
    FROM ways w JOIN steps e ON w.c = e.c AND e.p = w.p + 1 AND e.f = w.s) WHERE best = 1),
ends AS (
  SELECT w.c, w.cost + ins.cost AS cost, w.audit || ins.x AS audit, list_concat(w.made, ins.made) AS made,
    row_number() OVER (PARTITION BY w.c ORDER BY w.cost + ins.cost, w.audit || ins.x) AS best
  FROM ways w JOIN facts ON w.c = facts.c AND w.p = facts.n JOIN ins ON ins.f = w.s AND ins.t IN (0, 3))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM spaced) LEFT JOIN facts USING (c) LEFT JOIN (SELECT * FROM ends WHERE best = 1) USING (c)"""
