"""The same queries in SQL, for checking on DuckDB."""

from __future__ import annotations

from reviewmill.functions.text import SPACE_RANGES, SYMBOL_PATTERN, TAG_PATTERN, TOKEN_PATTERN, URL_PATTERN
from reviewmill.operators.report import NO_REVIEWS, PROMPT
from reviewmill.operators.topics import STOP_WORDS

SPACE = f"[{SPACE_RANGES}]+"
CLUSTER_KEYS = "app_id, sentiment, cluster"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def clean(x: str) -> str:
    for pattern in (TAG_PATTERN, URL_PATTERN, SYMBOL_PATTERN, SPACE):
        x = f"regexp_replace({x if x.startswith('regexp') else f'lower({x})'}, '{pattern}', ' ', 'g')"
    return f"trim({x})"


def text_hash(x: str) -> str:
    return f"sha256(lower({strip(x)}))"


def code(x: str) -> str:
    return f"CASE {x} WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END"


def int_text(x: str) -> str:
    return f"CASE WHEN regexp_full_match({strip(x)}, '[+-]?[0-9]+') THEN TRY_CAST({strip(x)} AS INTEGER) END"


def label_code(x: str) -> str:
    return f"COALESCE({code(f'lower({strip(x)})')}, {int_text(x)})"


# --- common inputs -----------------------------------------------------------------

RAW = """raw AS (
  SELECT source AS app_id, CAST(doc_id AS VARCHAR) AS reviewId, text AS content,
         CAST(n_chars % 5 + 1 AS INTEGER) AS score, CAST(n_chars % 100 AS INTEGER) AS thumbsUpCount, doc_id AS row_id
  FROM documents)"""

LABELED = RAW + """, labeled AS (
  SELECT raw.*, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS label
  FROM raw LEFT JOIN labels ON labels.doc_id = raw.row_id)"""

SENTIMENT = LABELED + ", felt AS (SELECT * EXCLUDE (label), label AS sentiment FROM labeled)"

GAPPY = LABELED + """, gappy AS (
  SELECT app_id, reviewId, score, thumbsUpCount, row_id,
    CASE thumbsUpCount % 10 WHEN 0 THEN ' ' || chr(160) || chr(10) WHEN 1 THEN NULL WHEN 2 THEN '😍🎉' ELSE '  ' || content || ' ' END AS content,
    CASE thumbsUpCount % 10 WHEN 3 THEN 'Positive' WHEN 4 THEN '2' WHEN 5 THEN 'invalid' ELSE label END AS label
  FROM labeled)"""

CLUSTERED = SENTIMENT + """, clustered AS (
  SELECT felt.*, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE -1 END AS cluster,
    CASE WHEN lang = 'en' THEN 'sign in | account | login screen keeps loading for ever'
         WHEN lang IN ('fr', 'de') THEN 'battery life | charging' ELSE 'Uncategorized' END AS topic
  FROM felt JOIN documents ON doc_id = row_id WHERE sentiment IS NOT NULL)"""

PAGES = """messy AS (
  SELECT page_id AS row_id, html || chr(160) || ' See ' || url || ' 😍🎉' || chr(10) || '☕ 漢字 (ok)! ' AS content FROM pages)"""

GUESSED = LABELED + f""", guessed AS (
  SELECT row_id, {code('label')} AS label, score % 3 AS prediction FROM labeled WHERE label IS NOT NULL)"""

PER_CLASS = GUESSED + """, sides AS (
  SELECT label AS cls, 1 AS support, CAST(label = prediction AS INTEGER) AS tp, 0 AS predicted FROM guessed
  UNION ALL SELECT prediction, 0, 0, 1 FROM guessed
), classes AS (
  SELECT cls, sum(support) AS support, sum(tp) AS tp,
    CASE WHEN sum(predicted) > 0 THEN sum(tp) / sum(predicted) ELSE 0 END AS precision,
    CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support) ELSE 0 END AS recall,
    CASE WHEN sum(predicted) + sum(support) > 0 THEN 2 * sum(tp) / (sum(predicted) + sum(support)) ELSE 0 END AS f1
  FROM sides GROUP BY cls)"""

TOP_BODY = """top AS (
  SELECT app_id, sentiment, row_number() OVER (PARTITION BY app_id, sentiment ORDER BY thumbsUpCount DESC NULLS LAST, row_id) AS rank,
         content, thumbsUpCount, reviewId
  FROM felt WHERE sentiment IN ('positive', 'neutral', 'negative') QUALIFY rank <= 5)"""

TOP = SENTIMENT + ", " + TOP_BODY

SHARES = """shares AS (
  SELECT app_id, sentiment, count(*) AS n,
         round_even(count(*) / sum(count(*)) OVER (PARTITION BY app_id) * 100, 2) AS pct
  FROM felt GROUP BY app_id, sentiment)"""

TOPICS = """totals AS (SELECT app_id, sentiment, count(*) AS total FROM clustered GROUP BY ALL
), counted AS (SELECT app_id, sentiment, topic, count(*) AS "count" FROM clustered WHERE cluster <> -1 GROUP BY ALL
), summed AS (
  SELECT app_id, sentiment, row_number() OVER (PARTITION BY app_id, sentiment ORDER BY "count" DESC, topic) AS rank,
         topic, "count", round_even("count" / total * 100, 1) AS percentage
  FROM counted JOIN totals USING (app_id, sentiment) QUALIFY rank <= 3)"""


def fetch_sql(base: str, picks: str, extra: str = "") -> str:
    return f"""WITH {base}, picked AS ({picks}), uniq AS (
      SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY app_id, reviewId ORDER BY src_rank, pos) = 1
    ), shuffled AS (
      SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY md5('42:' || reviewId)) AS sample_pos FROM uniq)
    SELECT {extra} app_id, reviewId, content, score, thumbsUpCount, row_id, src_rank, pos, sample_pos FROM shuffled WHERE sample_pos <= 25"""


def newest(n: int) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY row_id DESC) AS pos, 0 AS src_rank
      FROM raw QUALIFY pos <= {n}"""


def relevant(n: int) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY thumbsUpCount DESC NULLS LAST, row_id DESC) AS pos, 1 AS src_rank
      FROM raw QUALIFY pos <= {n}"""


def terms(rows: str, key: str, text: str, stop: bool = False) -> str:
    """CTE body: one row per one- or two-word term occurrence."""
    words = f"regexp_extract_all(lower({text}), '{TOKEN_PATTERN}')"
    if stop:
        listed = ", ".join(f"'{w}'" for w in STOP_WORDS)
        words = f"list_filter({words}, lambda w: w NOT IN ({listed}))"
    return f"""SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
      FROM (SELECT {key}, {words} AS w FROM {rows})"""


def vocab(occurrences: str, n_docs: str) -> str:
    return f"""SELECT term, df, n_docs, ln((n_docs + 1) / (df + 1)) + 1 AS idf
      FROM (SELECT term, count(DISTINCT row_id) AS df FROM {occurrences} GROUP BY term), (SELECT count(*) AS n_docs FROM {n_docs})
      WHERE df >= 2 AND df <= n_docs * 0.95"""


def weights(occurrences: str, vocabulary: str) -> str:
    return f"""SELECT row_id, term, w, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS weight FROM (
      SELECT row_id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM {occurrences} JOIN {vocabulary} USING (term) GROUP BY row_id, term)"""


SPLIT = LABELED + """, usable AS (SELECT * FROM labeled WHERE label IS NOT NULL AND content IS NOT NULL
), sizes AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM usable GROUP BY label
), shares AS (SELECT *, ceil(total * 0.2) AS n_test, floor(n * ceil(total * 0.2) / total) AS base,
              (n * CAST(ceil(total * 0.2) AS BIGINT)) % total AS rest FROM sizes
), quotas AS (SELECT label, base + CAST(row_number() OVER (ORDER BY rest DESC, label) <= n_test - sum(base) OVER () AS INTEGER) AS quota FROM shares
), splitted AS (
  SELECT usable.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) <= quota THEN 'test' ELSE 'train' END AS split
  FROM usable JOIN quotas USING (label))"""

BATCHED = LABELED + f""", prepared AS (
  SELECT row_id, {text_hash('content')} AS content_hash, 'app_reviews' AS source, score, thumbsUpCount AS thumbs_up_count, {code('label')} AS label,
    CASE WHEN label IS NOT NULL THEN 1 ELSE 2 END AS batch FROM labeled
), inserted AS (
  SELECT *, '00000000-0000-0000-0000-00000000000' || batch AS ingestion_batch_id FROM prepared
  QUALIFY row_number() OVER (PARTITION BY content_hash, source ORDER BY batch, row_id) = 1)"""

RUNS = """runs AS (
  SELECT lang AS model_name, lang || ':' || source AS run_id, CAST(substr(source, 4) AS BIGINT) AS seq, sum(quality) / count(*) AS test_f1
  FROM labels JOIN documents USING (doc_id) GROUP BY lang, source)"""


def history(gate: float, always: bool) -> str:
    best = "last_value(rival IGNORE NULLS)" if always else "max(rival)"
    wins = f"test_f1 >= {gate} AND (champion_f1 IS NULL OR {'true' if always else 'test_f1 > champion_f1'})"
    return f"""WITH {RUNS}, rivals AS (SELECT *, CASE WHEN test_f1 >= {gate} THEN test_f1 END AS rival FROM runs
    ), judged AS (SELECT * EXCLUDE (rival),
        {best} OVER (PARTITION BY model_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS champion_f1 FROM rivals
    ), decided AS (SELECT *, CASE WHEN {wins} THEN 'promoted' WHEN champion_f1 IS NULL THEN 'rejected' ELSE 'kept' END AS outcome FROM judged)
    SELECT *, CASE WHEN outcome = 'promoted' THEN CAST(sum(CAST(outcome = 'promoted' AS INTEGER)) OVER (PARTITION BY model_name ORDER BY seq) AS INTEGER) END AS version,
      outcome = 'promoted' AND seq = max(CASE WHEN outcome = 'promoted' THEN seq END) OVER (PARTITION BY model_name) AS is_champion FROM decided"""


DENSITY = """WITH RECURSIVE points AS (SELECT vec_id AS row_id, label % 3 AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), near AS (
  SELECT a.row_id AS src, b.row_id AS dst FROM points a JOIN points b ON a.grp = b.grp AND a.row_id <> b.row_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.30
), cores AS (SELECT src AS row_id FROM near GROUP BY src HAVING count(*) >= 2
), reach(row_id, root) AS (
  SELECT row_id, row_id FROM cores
  UNION
  SELECT near.dst, reach.root FROM reach JOIN near ON near.src = reach.row_id JOIN cores ON cores.row_id = near.dst
), roots AS (SELECT row_id, min(root) AS root FROM reach GROUP BY row_id
), big AS (SELECT root FROM roots GROUP BY root HAVING count(*) >= 5)
"""

HIERARCHY = """WITH RECURSIVE points AS (SELECT vec_id AS row_id, label % 3 AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), pairs AS (
  SELECT a.row_id AS src, b.row_id AS dst, list_cosine_similarity(a.v, b.v) AS s FROM points a JOIN points b ON a.grp = b.grp AND a.row_id <> b.row_id
), cuts AS (SELECT CAST(unnest([0.2, 0.25, 0.3]) AS DOUBLE) AS similarity
), near AS (SELECT similarity, src, dst FROM pairs JOIN cuts ON s >= similarity
), cores AS (SELECT similarity, src AS row_id FROM near GROUP BY ALL HAVING count(*) >= 2
), reach(similarity, row_id, root) AS (
  SELECT similarity, row_id, row_id FROM cores
  UNION
  SELECT similarity, near.dst, reach.root FROM reach JOIN near USING (similarity) JOIN cores USING (similarity)
  WHERE near.src = reach.row_id AND cores.row_id = near.dst
), roots AS (SELECT similarity, row_id, min(root) AS root FROM reach GROUP BY ALL
), big AS (SELECT similarity, root FROM roots GROUP BY ALL HAVING count(*) >= 5)
"""

CLUSTER_TEXT = CLUSTERED + f""", texts AS (
  SELECT {CLUSTER_KEYS}, string_agg(content, ' ' ORDER BY row_id) AS cluster_text FROM clustered WHERE cluster <> -1
  GROUP BY {CLUSTER_KEYS})"""


def overlap(a: str, b: str) -> str:
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    return f"len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))"


def keywords(rows: str) -> str:
    """CTEs that lead to named (cluster keys, keywords): three terms at diversity 0.5."""
    best = f"row_number() OVER (PARTITION BY {CLUSTER_KEYS} ORDER BY cost, term) = 1"
    return f"""occ AS ({terms(f"(SELECT * FROM {rows} WHERE cluster <> -1)", CLUSTER_KEYS, 'content', stop=True)}
), tf AS (SELECT {CLUSTER_KEYS}, term, count(*) AS tf FROM occ GROUP BY ALL
), words AS (SELECT {CLUSTER_KEYS}, sum(tf) AS words FROM tf GROUP BY ALL
), mean AS (SELECT app_id, avg(words) AS mean FROM words GROUP BY app_id
), overall AS (SELECT app_id, term, sum(tf) AS f FROM tf GROUP BY ALL
), raws AS (SELECT {CLUSTER_KEYS}, term, tf / words * ln(1 + mean / f) AS worth
  FROM tf JOIN words USING ({CLUSTER_KEYS}) JOIN mean USING (app_id) JOIN overall USING (app_id, term)
), scored AS MATERIALIZED (SELECT {CLUSTER_KEYS}, term, round(worth / max(worth) OVER (PARTITION BY {CLUSTER_KEYS}), 9) AS score FROM raws
), first_ AS (SELECT {CLUSTER_KEYS}, term AS t1, term, -score AS cost FROM scored QUALIFY {best}
), second_ AS (SELECT {CLUSTER_KEYS}, t1, s.term AS t2, s.term, round(0.5 * {overlap('t1', 's.term')} - 0.5 * score, 9) AS cost
  FROM scored s JOIN (SELECT * EXCLUDE (term, cost) FROM first_) USING ({CLUSTER_KEYS}) WHERE s.term <> t1 QUALIFY {best}
), third_ AS (SELECT {CLUSTER_KEYS}, s.term AS t3, s.term, round(0.5 * greatest({overlap('t1', 's.term')}, {overlap('t2', 's.term')}) - 0.5 * score, 9) AS cost
  FROM scored s JOIN (SELECT * EXCLUDE (term, cost) FROM second_) USING ({CLUSTER_KEYS}) WHERE s.term <> t1 AND s.term <> t2 QUALIFY {best}
), named AS (SELECT {CLUSTER_KEYS}, concat_ws(' | ', t1, t2, t3) AS keywords
  FROM first_ LEFT JOIN (SELECT * EXCLUDE (t1, term, cost) FROM second_) USING ({CLUSTER_KEYS}) LEFT JOIN (SELECT * EXCLUDE (term, cost) FROM third_) USING ({CLUSTER_KEYS}))"""


KEYWORDS = CLUSTERED + ", " + keywords("clustered")

def letters(x: str) -> str:
    """Counts of eight letters at unit length; without any of them, zeros."""
    counts = f"[CAST(length(lower(coalesce({x}, ''))) - length(replace(lower(coalesce({x}, '')), c, '')) AS DOUBLE) FOR c IN ['e', 't', 'a', 'o', 'i', 'n', 's', 'r']]"
    return unit(counts)


def unit(v: str) -> str:
    return f"[q / CASE WHEN list_inner_product({v}, {v}) > 0 THEN sqrt(list_inner_product({v}, {v})) ELSE 1 END FOR q IN {v}]"


def keywords_by_vector() -> str:
    best = f"row_number() OVER (PARTITION BY {CLUSTER_KEYS} ORDER BY cost, term) = 1"
    cosine = lambda a, b: f"list_inner_product({a}, {b})"
    means = ", ".join(f"avg(v[{i}])" for i in range(1, 9))
    return f"""occ AS ({terms("(SELECT * FROM clustered WHERE cluster <> -1)", CLUSTER_KEYS, 'content', stop=True)}
), coded AS (SELECT {CLUSTER_KEYS}, {letters('content')} AS v FROM clustered WHERE cluster <> -1
), sums AS (SELECT {CLUSTER_KEYS}, [{means}] AS m FROM coded GROUP BY ALL
), centres AS (SELECT {CLUSTER_KEYS}, {unit('m')} AS m FROM sums
), every AS MATERIALIZED (SELECT DISTINCT {CLUSTER_KEYS}, term, {letters('term')} AS v FROM occ
), scored AS MATERIALIZED (SELECT {CLUSTER_KEYS}, term, v, round({cosine('v', 'm')}, 9) AS score FROM every JOIN centres USING ({CLUSTER_KEYS})
), first_ AS (SELECT {CLUSTER_KEYS}, term AS t1, v AS v1, term, -score AS cost FROM scored QUALIFY {best}
), second_ AS (SELECT {CLUSTER_KEYS}, t1, v1, s.term AS t2, s.v AS v2, s.term, round(0.5 * {cosine('v1', 's.v')} - 0.5 * score, 9) AS cost
  FROM scored s JOIN (SELECT * EXCLUDE (term, cost) FROM first_) USING ({CLUSTER_KEYS}) WHERE s.term <> t1 QUALIFY {best}
), third_ AS (SELECT {CLUSTER_KEYS}, s.term AS t3, s.term, round(0.5 * greatest({cosine('v1', 's.v')}, {cosine('v2', 's.v')}) - 0.5 * score, 9) AS cost
  FROM scored s JOIN (SELECT * EXCLUDE (term, cost) FROM second_) USING ({CLUSTER_KEYS}) WHERE s.term <> t1 AND s.term <> t2 QUALIFY {best})
SELECT {CLUSTER_KEYS}, concat_ws(' | ', t1, t2, t3) AS keywords FROM first_ LEFT JOIN (SELECT {CLUSTER_KEYS}, t2 FROM second_) USING ({CLUSTER_KEYS})
  LEFT JOIN (SELECT {CLUSTER_KEYS}, t3 FROM third_) USING ({CLUSTER_KEYS})"""


GRID = "grid AS (SELECT app_id, unnest(['positive', 'neutral', 'negative']) AS sentiment FROM (SELECT DISTINCT app_id FROM felt))"

BLOCKS_BODY = f"""{GRID}, blocks AS (
  SELECT app_id, sentiment, COALESCE(block, '{NO_REVIEWS}') AS block FROM grid LEFT JOIN (
    SELECT app_id, sentiment, string_agg('- (' || thumbsUpCount || ' upvotes) ' || replace({strip('content')}, chr(10), ' '), chr(10) ORDER BY rank) AS block
    FROM top WHERE {strip('content')} <> '' GROUP BY app_id, sentiment) USING (app_id, sentiment))"""

HALF = LABELED + """, felt AS (
  SELECT * EXCLUDE (label), CASE WHEN regexp_matches(app_id, '[02468]$') THEN label END AS sentiment FROM labeled)"""

HALF_TOPICS = HALF + ", all_felt AS (SELECT * EXCLUDE (label), label AS sentiment FROM labeled), " + CLUSTERED.split("felt AS (SELECT * EXCLUDE (label), label AS sentiment FROM labeled), ", 1)[1].replace(
    "clustered AS (", "everything AS ("
).replace("FROM felt JOIN", "FROM all_felt JOIN").replace("SELECT felt.*", "SELECT all_felt.*") + """, clustered AS (
  SELECT * FROM everything WHERE regexp_matches(app_id, '[0369]$') AND sentiment <> 'neutral')"""

LANG_FELT = SENTIMENT + """, spoken AS (
  SELECT felt.* EXCLUDE (app_id), lang AS app_id FROM felt JOIN documents ON doc_id = row_id WHERE sentiment IS NOT NULL
), sizes AS (SELECT app_id, sentiment, count(*) AS n FROM spoken GROUP BY ALL)"""

LOOKUPS = """asked AS (SELECT event_id AS request_id, user_id AS key, ts, value < 1 AS forced FROM events WHERE event_type = 'view'
), stored AS (SELECT user_id AS key, ts AS created_at FROM events WHERE event_type = 'purchase')"""


TOP_LISTS = """top_lists AS (SELECT app_id, sentiment,
    string_agg('{"content":"' || sha256(content) || '","thumbsUpCount":' || thumbsUpCount || '}', ',' ORDER BY rank) AS l FROM top GROUP BY ALL
), top_maps AS (SELECT app_id, '{' || string_agg('"' || sentiment || '":[' || COALESCE(l, '') || ']', ',' ORDER BY sentiment) || '}' AS j
  FROM grid LEFT JOIN top_lists USING (app_id, sentiment) GROUP BY app_id)"""

TOPIC_LISTS = """topic_lists AS (SELECT app_id, sentiment,
    string_agg('{"topic":"' || topic || '","count":' || "count" || ',"percentage":' || percentage || '}', ',' ORDER BY rank) AS l FROM summed GROUP BY ALL
), topic_maps AS (SELECT app_id, '{' || string_agg('"' || sentiment || '":[' || COALESCE(l, '') || ']', ',' ORDER BY sentiment) || '}' AS j
  FROM grid LEFT JOIN topic_lists USING (app_id, sentiment) GROUP BY app_id)"""


def prompt_sql() -> str:
    pieces, rest = [], PROMPT
    for slot in ["topics", "positive", "neutral", "negative"]:
        head, rest = rest.split("{" + slot + "}")
        pieces += ["'" + head.replace("'", "''") + "'", slot]
    pieces.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(pieces)


PROMPTS = f"""{HALF_TOPICS}, {TOP_BODY}, {BLOCKS_BODY}, {TOPICS}, {TOPIC_LISTS}, wide AS (
  SELECT app_id, max(block) FILTER (sentiment = 'positive') AS positive, max(block) FILTER (sentiment = 'neutral') AS neutral,
    max(block) FILTER (sentiment = 'negative') AS negative FROM blocks GROUP BY app_id
), filled AS (SELECT wide.*, j AS topics FROM wide JOIN topic_maps USING (app_id)
), prompts AS (SELECT app_id, {prompt_sql()} AS prompt FROM filled)"""

TOPIC_FLOW = SENTIMENT + """, points AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment
  FROM embeddings WHERE vec_id IN (SELECT row_id FROM felt)
), near AS (
  SELECT a.row_id AS src, b.row_id AS dst FROM points a JOIN points b ON a.sentiment = b.sentiment AND a.row_id <> b.row_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.30
), cores AS (SELECT src AS row_id FROM near GROUP BY src HAVING count(*) >= 2
), reach(row_id, root) AS (
  SELECT row_id, row_id FROM cores
  UNION
  SELECT near.dst, reach.root FROM reach JOIN near ON near.src = reach.row_id JOIN cores ON cores.row_id = near.dst
), roots AS (SELECT row_id, min(root) AS root FROM reach GROUP BY row_id
), big AS (SELECT root, sentiment FROM roots JOIN points USING (row_id) GROUP BY root, sentiment HAVING count(*) >= 5
  QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY count(*) DESC, root) <= 2
), placed AS (SELECT 'all' AS app_id, points.sentiment, points.row_id, content, COALESCE(big.root, -1) AS cluster
  FROM points JOIN felt USING (row_id) LEFT JOIN roots USING (row_id) LEFT JOIN big ON big.root = roots.root)"""


def oracle_sql() -> dict[str, str]:
    clustered_topics = CLUSTERED + ", " + TOPICS
    occ = terms("raw", "row_id", "content")
    sql = {
        "fetch_newest": fetch_sql(RAW, newest(20)),
        "fetch_relevant": fetch_sql(RAW, relevant(20)),
        "fetch_all": fetch_sql(RAW, f"SELECT * FROM ({newest(20)}) UNION ALL SELECT * FROM ({relevant(20)})"),
        "latest_slice": f"""WITH {LABELED} SELECT row_id AS id, content, score, {code('label')} AS label, thumbsUpCount AS thumbs_up_count
            FROM labeled ORDER BY row_id DESC LIMIT 300""",
        "dedup_reviews": f"""WITH {RAW} SELECT app_id, {text_hash('content')} AS reviewId, content, score, thumbsUpCount, row_id FROM raw
            QUALIFY row_number() OVER (PARTITION BY app_id, {text_hash('content')} ORDER BY thumbsUpCount DESC, row_id) = 1""",
        "seeded_sample": f"""WITH {RAW} SELECT app_id, row_id, content, row_number() OVER (PARTITION BY app_id ORDER BY md5('42:' || reviewId)) AS sample_pos
            FROM raw QUALIFY sample_pos <= 20""",
        "sample_apps": """SELECT source AS app_id, count(*) AS reviews, md5('42:' || source) AS app_order,
              ['all_reviews', 'new_reviews', 'relevant_reviews'][CAST('0x' || substr(md5('42:strategy:' || source), 1, 4) AS INTEGER) % 3 + 1] AS strategy
            FROM documents GROUP BY source ORDER BY app_order LIMIT 2""",
        "fetch_sampled_apps": f"""WITH {RAW}, apps AS (SELECT source AS app_id,
              ['all_reviews', 'new_reviews', 'relevant_reviews'][CAST('0x' || substr(md5('42:strategy:' || source), 1, 4) AS INTEGER) % 3 + 1] AS strategy
              FROM documents GROUP BY source ORDER BY md5('42:' || source) LIMIT 2
            ), both_ AS (SELECT * FROM ({newest(20)}) UNION ALL SELECT * FROM ({relevant(20)})
            ), picked AS (SELECT both_.*, strategy FROM both_ JOIN apps USING (app_id) WHERE (strategy = 'new_reviews' AND src_rank = 0)
              OR (strategy = 'relevant_reviews' AND src_rank = 1) OR strategy = 'all_reviews'
            ), uniq AS (SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY app_id, reviewId ORDER BY src_rank, pos) = 1)
            SELECT app_id, strategy, row_id, content, src_rank, pos, row_number() OVER (PARTITION BY app_id ORDER BY md5('42:' || reviewId)) AS sample_pos
            FROM uniq QUALIFY sample_pos <= 25""",
        "cap_per_sentiment": f"""WITH {SENTIMENT} SELECT app_id, sentiment, row_id, content FROM felt
            QUALIFY sentiment IS NULL OR row_number() OVER (PARTITION BY app_id, sentiment ORDER BY md5('42:' || row_id)) <= 5""",
        "strip_html": f"SELECT page_id, regexp_replace(html, '{TAG_PATTERN}', ' ', 'g') AS plain FROM pages",
        "strip_urls": f"SELECT page_id, regexp_replace('at ' || url || chr(8195) || 'or www.' || url, '{URL_PATTERN}', ' ', 'g') AS plain FROM pages",
        "strip_emoji": f"WITH {PAGES} SELECT row_id, regexp_replace(content, '{SYMBOL_PATTERN}', ' ', 'g') AS plain FROM messy",
        "clean_text": f"""WITH {PAGES}, both_ AS (SELECT 'documents' AS origin, doc_id AS row_id, text AS content FROM documents
            UNION ALL SELECT 'pages', row_id, content FROM messy) SELECT origin, row_id, {clean('content')} AS cleaned FROM both_""",
        "drop_blank": f"WITH {GAPPY} SELECT row_id, {strip('content')} AS content FROM gappy WHERE {strip('content')} <> ''",
        "transform_reviews": f"""WITH {GAPPY}, cleaned AS (SELECT row_id, {clean('content')} AS content, label AS was, COALESCE({code('label')}, {int_text('label')}) AS label FROM gappy)
            SELECT row_id, content, label, CASE WHEN label IS NULL THEN was END AS label_raw FROM cleaned WHERE content <> ''""",
        "encode_label": f"WITH {GAPPY} SELECT row_id, {code('label')} AS code FROM gappy",
        "decode_label": f"WITH {GUESSED} SELECT row_id, CASE prediction WHEN 0 THEN 'negative' WHEN 2 THEN 'positive' ELSE 'unknown' END AS sentiment FROM guessed",
        "dropna_any": f"WITH {GAPPY} SELECT row_id, app_id, reviewId, thumbsUpCount, label FROM gappy WHERE content IS NOT NULL AND label IS NOT NULL",
        "null_profile": f"WITH {GAPPY} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM gappy"
            for c in ["row_id", "app_id", "reviewId", "content", "score", "thumbsUpCount", "label"]
        ),
        "normalize_label": f"""WITH {LABELED}, answers AS (SELECT row_id, lower(CASE WHEN label = 'negative' THEN 'NEGATIVE, not neutral ' || app_id
              ELSE 'Label_' || COALESCE(label, app_id) END) AS a FROM labeled)
            SELECT row_id, CASE WHEN contains(a, 'positive') THEN 'Positive' WHEN contains(a, 'negative') THEN 'Negative'
              WHEN contains(a, 'neutral') THEN 'Neutral' ELSE a END AS label FROM answers""",
        "extract_app_id": """WITH forms AS (SELECT page_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS form, unnest([url,
              'https://play.google.com/store/apps/details?hl=en&id=com.app.p' || page_id || '&gl=us',
              'https://market.android.com/store/apps/details?id=org.app.' || page_id,
              'https://play.google.com/store/apps/details?hl=en&page=' || page_id,
              'https://other.example.com/store/apps/details?id=com.app.p' || page_id,
              'com.plain.app' || page_id, 'an app. number ' || page_id]) AS link FROM pages)
            SELECT page_id, form, CASE WHEN regexp_matches(link, '^https?://(play[.]google[.]com|market[.]android[.]com)/store/apps/details[?](.*&)?id=')
                THEN regexp_extract(link, '[?&]id=([^&#]+)', 1)
              WHEN contains(link, '.') AND NOT contains(link, '/') AND NOT contains(link, ' ') THEN link ELSE '' END AS app_id FROM forms""",
        "content_hash": f"SELECT doc_id AS row_id, {text_hash("(chr(160) || ' ' || text || chr(8195) || chr(10))")} AS content_hash FROM documents",
        "safe_int": """SELECT event_id, CAST(trunc(value) AS INTEGER) AS from_double, CAST(floor(value) AS INTEGER) AS from_padded,
            CAST(NULL AS INTEGER) AS from_decimal, CAST(NULL AS INTEGER) AS from_word, CAST(-floor(value) AS INTEGER) AS from_signed FROM events""",
        "safe_label": f"WITH {GAPPY} SELECT row_id, {label_code("(' ' || upper(label) || chr(160))")} AS from_text, score AS from_number FROM gappy",
        "prepare_rows": f"""WITH {GAPPY} SELECT row_id, content, score, thumbsUpCount AS thumbs_up_count, {label_code('label')} AS label,
              {text_hash('content')} AS content_hash, 'app_reviews' AS source, '00000000-0000-0000-0000-000000000001' AS ingestion_batch_id,
              TIMESTAMP '2024-01-01 00:00:00' AS ingested_at FROM gappy WHERE {strip('content')} <> ''""",
        "lake_append": f"WITH {BATCHED} SELECT row_id, content_hash, source, ingestion_batch_id, score, thumbs_up_count, label FROM inserted",
        "load_summary": f"""WITH {BATCHED}, tried AS (SELECT batch, count(*) AS attempted FROM prepared GROUP BY batch
            ), added AS (SELECT batch, count(*) AS n FROM inserted GROUP BY batch)
            SELECT '00000000-0000-0000-0000-00000000000' || batch AS ingestion_batch_id, attempted, COALESCE(n, 0) AS inserted,
              attempted - COALESCE(n, 0) AS skipped FROM tried LEFT JOIN added USING (batch)""",
        "batch_audit": f"""WITH {BATCHED} SELECT CAST('2024-01-0' || batch AS DATE) AS ingest_date, ingestion_batch_id, source, count(*) AS n_rows,
              count(label) AS n_labeled, CAST('2024-01-0' || batch AS TIMESTAMP) AS first_at, CAST('2024-01-0' || batch AS TIMESTAMP) AS last_at
            FROM inserted GROUP BY batch, ingestion_batch_id, source""",
        "stream_ingest": f"""WITH {RAW}, cleaned AS (SELECT row_id, {clean('content')} AS content, score, thumbsUpCount FROM raw
            ), kept AS (SELECT *, {text_hash('content')} AS content_hash FROM cleaned WHERE content <> ''
              QUALIFY row_number() OVER (PARTITION BY {text_hash('content')} ORDER BY row_id) = 1)
            SELECT row_number() OVER (ORDER BY row_id) AS id, content_hash, 'app_reviews' AS source, score, thumbsUpCount AS thumbs_up_count FROM kept""",
        "sentiment_percentages": f"WITH {SENTIMENT}, {SHARES} SELECT * FROM shares",
        "label_distribution": f"""WITH {LABELED} SELECT app_id, label, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY app_id) * 100, 2) AS pct
            FROM labeled WHERE label IS NOT NULL GROUP BY app_id, label""",
        "report_shares": f"""WITH {SENTIMENT}, {SHARES} SELECT app_id, COALESCE(sentiment, 'unknown') AS sentiment, n, pct,
            CASE sentiment WHEN 'positive' THEN 1 WHEN 'neutral' THEN 2 WHEN 'negative' THEN 3 ELSE 4 END AS display_pos FROM shares""",
        "top_reviews": f"WITH {TOP} SELECT app_id, sentiment, rank, content, thumbsUpCount FROM top",
        "top_by_label": f"WITH {TOP} SELECT app_id, sentiment AS label, rank, content, thumbsUpCount FROM top",
        "top_reviews_nested": f"""WITH {TOP}, {GRID}, listed AS (SELECT app_id, sentiment,
              string_agg('{{"content":"' || sha256(content) || '","thumbsUpCount":' || thumbsUpCount || '}}', ',' ORDER BY rank) AS j FROM top GROUP BY ALL)
            SELECT app_id, '{{' || string_agg('"' || sentiment || '":[' || COALESCE(j, '') || ']', ',' ORDER BY sentiment) || '}}' AS top_reviews_json
            FROM grid LEFT JOIN listed USING (app_id, sentiment) GROUP BY app_id""",
        "topic_summary": f"WITH {clustered_topics} SELECT * FROM summed",
        "report_topics": f"""WITH {clustered_topics} SELECT app_id, sentiment, rank,
              CASE WHEN length(topic) > 45 THEN left(topic, 45) || '…' ELSE topic END AS label,
              regexp_replace(CAST(percentage AS VARCHAR), '\\.0$', '') || '% (' || "count" || ')' AS caption,
              round(percentage / greatest(max(percentage) OVER (PARTITION BY app_id, sentiment), 1.0) * 100, 4) AS bar_width FROM summed""",
        "top_clusters": f"""WITH {CLUSTERED}, ranked AS (SELECT app_id, sentiment, cluster + 1 AS cluster,
              row_number() OVER (PARTITION BY app_id, sentiment ORDER BY count(*) DESC, cluster) AS place FROM clustered GROUP BY app_id, sentiment, cluster)
            SELECT row_id, content, c.app_id, c.sentiment, CASE WHEN place <= 3 THEN r.cluster ELSE -1 END AS cluster
            FROM clustered c JOIN ranked r ON c.app_id = r.app_id AND c.sentiment = r.sentiment AND c.cluster + 1 = r.cluster""",
        "cluster_stats": f"""WITH {CLUSTERED} SELECT app_id, sentiment, count(*) AS n_rows, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
              count(*) FILTER (cluster = -1) AS n_noise, round_even(count(*) FILTER (cluster = -1) / count(*) * 100, 1) AS noise_pct
            FROM clustered GROUP BY app_id, sentiment""",
        "keyword_list": f"""WITH {CLUSTERED}, names AS (SELECT DISTINCT app_id, sentiment, cluster, topic FROM clustered WHERE cluster <> -1)
            SELECT app_id, sentiment, string_agg(replace(topic, ' | ', '; '), '; ' ORDER BY cluster) AS keywords FROM names GROUP BY app_id, sentiment""",
        "analysis_result": f"""WITH {HALF_TOPICS}, {TOP_BODY}, {SHARES}, {TOPICS}, {GRID}, {TOP_LISTS}, {TOPIC_LISTS}
            SELECT app_id, 'new_reviews' AS scraping_method, count(*) AS review_count,
              {', '.join(f"(SELECT pct FROM shares s WHERE s.app_id = f.app_id AND COALESCE(s.sentiment, 'unknown') = '{c}') AS pct_{c}" for c in ['positive', 'neutral', 'negative', 'unknown'])},
              (SELECT j FROM top_maps t WHERE t.app_id = f.app_id) AS top_reviews, (SELECT j FROM topic_maps t WHERE t.app_id = f.app_id) AS topic_summary,
              '' AS llm_insight FROM felt f GROUP BY app_id""",
        "review_block": f"WITH {HALF}, {TOP_BODY}, {BLOCKS_BODY} SELECT app_id, sentiment, block FROM blocks",
        "insight_prompt": f"WITH {PROMPTS} SELECT app_id, prompt FROM prompts",
        "completion": f"WITH {PROMPTS} SELECT app_id, length(prompt) || ': ' || right(prompt, 3) AS insight FROM prompts",
        "csv_reviews": """SELECT 'say "' || regexp_replace(text, '[\\r\\n]', ' ', 'g') || '", done' AS content,
              CASE WHEN doc_id % 10 <> 0 THEN CAST(n_chars % 5 AS INTEGER) END AS score, CAST(doc_id AS INTEGER) AS thumbsUpCount, source AS label FROM documents""",
        "metrics_by_split": f"""WITH {SPLIT}, hits AS (SELECT split, {code('label')} AS label, score % 3 AS prediction FROM splitted
            ), sides AS (SELECT split, label AS cls, 1 AS support, CAST(label = prediction AS INTEGER) AS tp, 0 AS predicted FROM hits
              UNION ALL SELECT split, prediction, 0, 0, 1 FROM hits
            ), classes AS (SELECT split, cls, sum(support) AS support, sum(tp) AS tp,
                CASE WHEN sum(predicted) > 0 THEN sum(tp) / sum(predicted) ELSE 0 END AS precision,
                CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support) ELSE 0 END AS recall,
                CASE WHEN sum(predicted) + sum(support) > 0 THEN 2 * sum(tp) / (sum(predicted) + sum(support)) ELSE 0 END AS f1
              FROM sides GROUP BY split, cls)
            SELECT split, round(sum(tp) / sum(support), 9) AS accuracy, {', '.join(f'round(sum({m} * support) / sum(support), 9) AS {m}' for m in ['precision', 'recall', 'f1'])},
              CAST(sum(support) AS BIGINT) AS n FROM classes GROUP BY split""",
        "svm_converged": f"""WITH {LABELED} SELECT {code('label')} AS label, count(*) AS n, true AS converged FROM labeled
            WHERE label IS NOT NULL AND {clean('content')} <> '' GROUP BY label""",
        "group_moments": """WITH sided AS (SELECT CASE WHEN label < 5 THEN 'positive' ELSE 'negative' END AS sentiment, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            ), axes AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS i)
            SELECT 'all' AS app_id, sentiment, count(*) AS n, a.i, b.i AS j, round(avg(v[a.i + 1]), 6) AS mean,
              round(avg(v[a.i + 1] * v[b.i + 1]) - avg(v[a.i + 1]) * avg(v[b.i + 1]), 6) AS cov FROM sided, axes a, axes b GROUP BY sentiment, a.i, b.i""",
        "ngrams": f"WITH {RAW}, occ AS ({occ}) SELECT row_id, term, count(*) AS tf FROM occ GROUP BY row_id, term",
        "vocabulary": f"WITH {RAW}, occ AS ({occ}), vocab AS ({vocab('occ', 'raw')}) SELECT term, df, n_docs, round(idf, 6) AS idf FROM vocab",
        "tfidf_weights": f"""WITH {RAW}, occ AS ({occ}), vocab AS ({vocab('occ', 'raw')}), weighted AS ({weights('occ', 'vocab')})
            SELECT row_id, term, round(weight, 6) AS weight FROM weighted""",
        "tfidf_train_test": f"""WITH {SPLIT}, train AS (SELECT * FROM splitted WHERE split = 'train'), test AS (SELECT * FROM splitted WHERE split = 'test'),
            occ1 AS ({terms('train', 'row_id', 'content')}), occ2 AS ({terms('test', 'row_id', 'content')}),
            vocab AS ({vocab('occ1', 'train')}), weighted AS ({weights('occ2', 'vocab')}) SELECT row_id, term, round(weight, 6) AS weight FROM weighted""",
        "stratified_split": f"WITH {SPLIT} SELECT row_id, label, split FROM splitted",
        "plain_split": """SELECT doc_id AS row_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id)) <= ceil(count(*) OVER () * 0.2)
            THEN 'test' ELSE 'train' END AS split FROM documents""",
        "embedding_misses": """SELECT sha256(text) AS text_hash, length(any_value(text)) AS chars FROM documents
            WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY text_hash""",
        "l2_normalize": """WITH wide AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (label + 2)) AS v FROM embeddings
            ), sized AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM wide)
            SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS at, round(unnest(v) / size, 6) AS v FROM sized""",
        "class_weights": f"""WITH {LABELED} SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight
            FROM labeled WHERE label IS NOT NULL GROUP BY label""",
        "weighted_metrics": f"""WITH {PER_CLASS} SELECT round(sum(tp) / sum(support), 9) AS accuracy,
              {', '.join(f'round(sum({m} * support) / sum(support), 9) AS {m}' for m in ['precision', 'recall', 'f1'])}, CAST(sum(support) AS BIGINT) AS n FROM classes""",
        "classification_report": f"""WITH {PER_CLASS}, total AS (SELECT sum(support) AS s FROM classes)
            SELECT CAST(cls AS VARCHAR) AS name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM classes
            UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM classes
            UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM classes
            UNION ALL SELECT 'weighted avg', {', '.join(f'round(sum({m} * support) / sum(support), 9)' for m in ['precision', 'recall', 'f1'])}, CAST(sum(support) AS BIGINT) FROM classes""",
        "champion_history": history(0.5, False),
        "champion_history_always": history(0.8, True),
        "bulk_label": f"""WITH {GAPPY} SELECT row_id, ['positive', 'negative', 'neutral'][length(COALESCE(content, '')) % 3 + 1] AS label FROM gappy""",
        "scoring_rows": f"WITH {GAPPY} SELECT row_id, {clean('content')} <> '' AS scored FROM gappy WHERE content IS NOT NULL",
        "linear_scores": f"""WITH {LABELED}, known AS (SELECT * FROM labeled WHERE label IS NOT NULL), occ AS ({terms('known', 'row_id, label', 'content')}),
            vocab AS ({vocab('occ', 'known')}), coefs AS (SELECT term, df, {', '.join(f"count(DISTINCT CASE WHEN label = '{c}' THEN row_id END) / df - 1.0 / 3 AS c{i}" for i, c in enumerate(['negative', 'neutral', 'positive']))}
              FROM occ JOIN vocab USING (term) GROUP BY term, df
            ), every AS ({terms('raw', 'row_id', 'content')}), plain AS ({weights('every', 'vocab')}), cleaned AS (SELECT row_id, {clean('content')} AS content FROM raw
            ), again AS ({terms('cleaned', 'row_id', 'content')}), reweighed AS ({weights('again', 'vocab')}),
            sums AS (SELECT row_id, {', '.join(f'sum(weight * c{i}) + {b} AS s{i}' for i, b in enumerate([0.25, 0.0, -0.25]))} FROM plain JOIN coefs USING (term) GROUP BY row_id
            ), decided AS (SELECT row_id, {', '.join(f'sum(weight * c{i}) + {b} AS s{i}' for i, b in enumerate([0.25, 0.0, -0.25]))} FROM reweighed JOIN coefs USING (term) GROUP BY row_id)
            SELECT cleaned.row_id, CASE WHEN content = '' THEN 'unknown' WHEN decided.s0 IS NULL THEN 'negative' WHEN decided.s0 >= decided.s1 AND decided.s0 >= decided.s2 THEN 'negative'
                WHEN decided.s1 >= decided.s2 THEN 'neutral' ELSE 'positive' END AS sentiment, {', '.join(f'round(sums.s{i}, 6) AS score_{i}' for i in range(3))}
            FROM cleaned LEFT JOIN sums USING (row_id) LEFT JOIN decided USING (row_id)""",
        "model_registry": f"""WITH {LABELED}, known AS (SELECT * FROM labeled WHERE label IS NOT NULL), occ AS ({terms('known', 'row_id, label', 'content')}),
            vocab AS ({vocab('occ', 'known')}), coefs AS (SELECT term, df, {', '.join(f"count(DISTINCT CASE WHEN label = '{c}' THEN row_id END) / df - 1.0 / 3 AS c{i}" for i, c in enumerate(['negative', 'neutral', 'positive']))}
              FROM occ JOIN vocab USING (term) GROUP BY term, df
            ), cleaned AS (SELECT row_id, {clean('content')} AS content FROM raw), again AS ({terms('cleaned', 'row_id', 'content')}), reweighed AS ({weights('again', 'vocab')}),
            sums AS (SELECT row_id, {', '.join(f'sum(weight * c{i}) AS s{i}' for i in range(3))} FROM reweighed JOIN coefs USING (term) GROUP BY row_id),
            runs(k, b0, b1, b2) AS (VALUES (0, 0.0, 0.0, 0.0), (1, 0.25, 0.0, -0.25), (2, -0.5, -0.5, 0.5), (3, 0.25, 0.0, -0.25)),
            scores AS (SELECT k, row_id, content, {', '.join(f'coalesce(s{i}, 0) + b{i} AS s{i}' for i in range(3))} FROM cleaned CROSS JOIN runs LEFT JOIN sums USING (row_id)),
            decided AS (SELECT k, row_id, CASE WHEN content = '' THEN NULL WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS guess FROM scores),
            hits AS (SELECT k, {code('label')} AS cls, guess FROM decided JOIN known USING (row_id) WHERE guess IS NOT NULL),
            sides AS (SELECT k, cls, 1 AS support, CAST(cls = guess AS INTEGER) AS tp, 0 AS predicted FROM hits UNION ALL SELECT k, guess, 0, 0, 1 FROM hits),
            classes AS (SELECT k, cls, sum(support) AS support, CASE WHEN sum(predicted) + sum(support) > 0 THEN 2 * sum(tp) / (sum(predicted) + sum(support)) ELSE 0 END AS f1 FROM sides GROUP BY k, cls),
            measured AS (SELECT k, round(sum(f1 * support) / sum(support), 9) AS f1 FROM classes GROUP BY k),
            gates AS (SELECT k, f1, coalesce(f1 > max(f1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS wins FROM measured),
            champion AS (SELECT max(k) AS k, CAST(count(*) AS INTEGER) AS version, max(f1) AS f1 FROM gates WHERE wins)
            SELECT row_id, CASE guess WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' ELSE 'unknown' END AS sentiment,
              'r' || k AS champion, version, f1 FROM decided JOIN champion USING (k)""",
        "eligible_groups": f"WITH {LANG_FELT} SELECT * FROM sizes WHERE n >= 30",
        "cluster_params": f"""WITH {LANG_FELT}, sized AS (SELECT *, CAST(greatest(15, least(80, floor(n * 0.02))) AS INTEGER) AS min_cluster_size FROM sizes)
            SELECT *, CAST(greatest(5, min_cluster_size // 5) AS INTEGER) AS min_samples FROM sized""",
        "density_core_points": DENSITY + "SELECT row_id, row_id IN (SELECT row_id FROM cores) AS core FROM points",
        "density_blocked": DENSITY + """SELECT points.row_id, COALESCE(big.root, -1) AS cluster
            FROM points LEFT JOIN roots USING (row_id) LEFT JOIN big ON big.root = roots.root""",
        "hierarchy_cuts": HIERARCHY + """SELECT points.row_id, COALESCE(big.root, -1) AS cluster, c.similarity
            FROM points CROSS JOIN cuts c LEFT JOIN roots ON roots.row_id = points.row_id AND roots.similarity = c.similarity
            LEFT JOIN big ON big.root = roots.root AND big.similarity = c.similarity""",
        "topic_flow": f"""WITH RECURSIVE {TOPIC_FLOW}, {keywords('placed')}, clustered AS (
              SELECT placed.*, CASE WHEN cluster = -1 THEN 'Uncategorized' ELSE COALESCE(keywords, 'N/A') END AS topic
              FROM placed LEFT JOIN named USING ({CLUSTER_KEYS})), {TOPICS} SELECT * FROM summed""",
        "density_clusters": DENSITY + """SELECT points.row_id, COALESCE(big.root, -1) AS cluster
            FROM points LEFT JOIN roots USING (row_id) LEFT JOIN big ON big.root = roots.root""",
        "cluster_text": f"WITH {CLUSTER_TEXT} SELECT * FROM texts",
        "cluster_keywords": f"WITH {KEYWORDS} SELECT * FROM named",
        "keyphrases_by_vector": f"WITH {CLUSTERED}, {keywords_by_vector()}",
        "topic_names": f"""WITH {KEYWORDS}, sizes AS (SELECT {CLUSTER_KEYS}, count(*) AS n FROM clustered GROUP BY ALL)
            SELECT {CLUSTER_KEYS}, n, CASE WHEN cluster = -1 THEN 'Uncategorized' ELSE COALESCE(keywords, 'N/A') END AS topic
            FROM sizes LEFT JOIN named USING ({CLUSTER_KEYS})""",
        "fresh_results": f"""WITH {LOOKUPS}, met AS (SELECT request_id, asked.key, ts, forced, created_at FROM asked ASOF LEFT JOIN stored ON asked.key = stored.key AND asked.ts >= stored.created_at
            ), judged AS (SELECT *, COALESCE(NOT forced AND ts < created_at + INTERVAL 1800 SECOND, false) AS hit FROM met)
            SELECT request_id, key, ts, hit, CASE WHEN hit THEN created_at END AS result_at FROM judged""",
        "fresh_results_invalidate": f"""WITH {LOOKUPS}, happened AS (
              SELECT request_id, key, ts, 2 AS kind, forced, NULL AS created_at FROM asked
              UNION ALL SELECT NULL, key, created_at, 0, false, created_at FROM stored
              UNION ALL SELECT event_id, user_id, ts, 1, false, NULL FROM events WHERE event_type = 'error'
            ), met AS (SELECT *, last_value(CASE WHEN kind < 2 THEN {{'kind': kind, 'at': created_at}} END IGNORE NULLS)
                OVER (PARTITION BY key ORDER BY ts, kind, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM happened
            ), judged AS (SELECT *, COALESCE(m.kind = 0 AND ts < m.at + INTERVAL 1800 SECOND AND NOT forced, false) AS hit FROM met WHERE kind > 0)
            SELECT request_id, key, ts, CASE WHEN kind = 2 THEN 'request' ELSE 'removal' END AS kind, hit, CASE WHEN hit THEN m.at END AS result_at FROM judged""",
    }
    sql["neighbour_recall"] = """WITH sized AS (SELECT label % 3 AS grp, count(*) AS n FROM embeddings GROUP BY ALL),
        asked AS (SELECT label % 3 AS grp, count(*) AS q FROM embeddings WHERE vec_id % 100 = 0 GROUP BY ALL)
        SELECT grp, CAST(q * least(10, n - 1) AS BIGINT) AS n, true AS enough FROM asked JOIN sized USING (grp)"""
    sql["fresh_results_stream"] = sql["fresh_results_invalidate"]
    sql["stream_ingest_replayed"] = sql["stream_ingest"]
    return sql
