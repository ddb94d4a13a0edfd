"""The same results as the registered queries, in SQL for DuckDB."""

from __future__ import annotations

# Fixed values, written out again so that a fault of the engine's lists shows.
BLANKS = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_BLANKS = " || ".join(f"chr({c})" for c in BLANKS)
_WORD = "[A-Za-zÀ-ÿ]{8,}"
_DIM = 256

DOCS = f"""docs AS (
  SELECT doc_id, lang, source,
         trim(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '  ', ' '), {_BLANKS}) AS clean
  FROM documents)"""

SENTENCES = DOCS + f""",
parts AS (
  SELECT doc_id, lang, source,
         string_split(regexp_replace(clean, '([.!?…]+)\\s+|([。！？]+)\\s*', '\\1\\2' || chr(10), 'g'), chr(10)) AS a
  FROM docs),
sentences AS (
  SELECT doc_id, lang, source, i - 1 AS sentence_no, trim(s, {_BLANKS}) AS sentence
  FROM (SELECT doc_id, lang, source, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM parts)
  WHERE length(trim(s, {_BLANKS})) > 0)"""

ABBREVIATIONS = """,
runs AS (SELECT unnest(regexp_extract_all(clean, '[A-Za-zÀ-ÿ]+\\.?')) AS run FROM docs),
abbreviations AS (
  SELECT lower(rtrim(run, '.')) AS word, count(*) FILTER (ends_with(run, '.')) AS dotted,
         count(*) FILTER (NOT ends_with(run, '.')) AS plain
  FROM runs WHERE length(rtrim(run, '.')) <= 4 GROUP BY word HAVING dotted >= 5 AND 100 * dotted >= 20 * (dotted + plain))"""

MENTIONS = SENTENCES + f""",
located AS (
  SELECT *, regexp_extract_all(sentence, '{_WORD}') AS texts, regexp_split_to_array(sentence, '{_WORD}') AS gaps FROM sentences),
words AS (
  SELECT doc_id, lang, source, sentence_no, sentence, texts[i] AS term,
         CAST(list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(h) for h in texts[1:i - 1]]), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM located)),
terms AS (
  SELECT lower(term) AS folded FROM (SELECT DISTINCT doc_id, sentence_no, term FROM words) GROUP BY ALL HAVING count(*) >= 10),
mentions AS (
  SELECT doc_id AS document_id, lang AS source_language, source, sentence_no,
         sentence AS clean_mention_sentence, term AS clean_entity_mention,
         s AS mention_start, s + length(term) AS mention_end, 'TERM' AS entity_type
  FROM words JOIN terms ON folded = lower(term)),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY document_id, sentence_no, mention_start, clean_entity_mention) - 1 AS row_id
  FROM mentions)"""

# The marked sentence of a row of `numbered`; its mention is always the term, because all spans are valid.
CONTEXTS = MENTIONS + """,
rows AS (
  SELECT *, clean_entity_mention AS mention,
         substr(clean_mention_sentence, 1, mention_start) || ' <mention> ' || clean_entity_mention || ' </mention> '
           || substr(clean_mention_sentence, mention_end + 1) AS context
  FROM numbered)"""


def encoded(name: str, items: str) -> str:
    """CTEs that end in `name`(item, vec) for the distinct texts `item` of a query."""
    return f""",
{name}_items AS (SELECT DISTINCT item FROM ({items}) WHERE item IS NOT NULL),
{name}_cells AS (
  SELECT item, (961 * unicode(substr(p, i, 1)) + 31 * unicode(substr(p, i + 1, 1)) + unicode(substr(p, i + 2, 1))) % {_DIM}
           AS dim
  FROM (SELECT item, p, unnest(range(1, length(p) - 1)) AS i
        FROM (SELECT item, ' ' || lower(item) || ' ' AS p FROM {name}_items))),
{name}_counts AS (SELECT item, dim, CAST(count(*) AS DOUBLE) AS n FROM {name}_cells GROUP BY item, dim),
{name}_norms AS (SELECT item, sqrt(sum(n * n)) AS length FROM {name}_counts GROUP BY item),
{name} AS (
  SELECT item, list(CAST(coalesce(c.n, 0) / l.length AS FLOAT) ORDER BY d.dim) AS vec
  FROM {name}_norms l CROSS JOIN (SELECT unnest(range({_DIM})) AS dim) d
  LEFT JOIN {name}_counts c USING (item, dim)
  GROUP BY item)"""


def dot(a: str, b: str) -> str:
    return f"round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def long_form(source: str, key: str = "row_id", vec: str = "vec") -> str:
    return f"""SELECT {key}, dim, round(CAST(x AS DOUBLE), 6) AS value
FROM (SELECT {key}, unnest({vec}) AS x, unnest(range(len({vec}))) AS dim FROM {source}) WHERE x <> 0"""


MENTION_VECS = CONTEXTS + encoded("m", "SELECT mention AS item FROM rows")
CONTEXT_VECS = CONTEXTS + encoded("c", "SELECT context AS item FROM rows")
BOTH_VECS = MENTION_VECS + encoded("c", "SELECT context AS item FROM rows")
BLENDS = BOTH_VECS + """,
sums AS (
  SELECT r.row_id, [CAST(0.6 AS DOUBLE) * m.vec[i] + CAST(0.4 AS DOUBLE) * c.vec[i] for i in range(1, 257)] AS v
  FROM rows r JOIN m ON m.item = r.mention JOIN c ON c.item = r.context),
blends AS (
  SELECT row_id, [CAST(x / length AS FLOAT) for x in v] AS vec
  FROM (SELECT row_id, v, sqrt(list_dot_product(v, v)) AS length FROM sums))"""

WORD_QUERIES = f""",
asked AS (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS query_id
  FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS term FROM benchmark))""" + encoded(
    "q", "SELECT term AS item FROM asked"
)

# Scores of all word queries against the mention vectors, (query_id, row_id, score).
WORD_SCORES = MENTION_VECS + WORD_QUERIES + f""",
texts AS (SELECT a.query_id, m.item, {dot('q.vec', 'm.vec')} AS score FROM asked a JOIN q ON q.item = a.term, m),
scores AS (SELECT t.query_id, r.row_id, t.score FROM texts t JOIN rows r ON r.mention = t.item)"""


def hits(k: str, cutoff: float, scores: str = "scores") -> str:
    """CTEs that end in `hits`: the pool of 4·k, the cutoff and its fallback."""
    return f""",
pool AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS place FROM {scores}
  QUALIFY place <= 4 * {k}),
hits AS (
  SELECT *, score AS similarity_score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank,
         count(*) FILTER (score >= {cutoff}) OVER (PARTITION BY query_id) AS passed
  FROM pool QUALIFY rank <= {k} AND (score >= {cutoff} OR passed = 0))"""


TEXT_QUERIES = encoded("q", "SELECT text AS item FROM benchmark")
CONTEXT_SCORES = CONTEXT_VECS + TEXT_QUERIES + f""",
texts AS (SELECT b.item_id AS query_id, c.item, {dot('q.vec', 'c.vec')} AS score FROM benchmark b JOIN q ON q.item = b.text, c),
scores AS (SELECT t.query_id, r.row_id, t.score FROM texts t JOIN rows r ON r.context = t.item)"""

EMBEDDINGS = """vecs AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""
CENTROIDS = EMBEDDINGS + """,
cells AS (SELECT label, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM vecs),
means AS (SELECT label, dim, avg(x) AS x FROM cells GROUP BY label, dim),
packed AS (SELECT label, list(x ORDER BY dim) AS v FROM means GROUP BY label),
centroids AS (
  SELECT label, [x / CASE WHEN length > 0 THEN length ELSE 1 END for x in v] AS centroid
  FROM (SELECT label, v, sqrt(list_dot_product(v, v)) AS length FROM packed))"""
MEDOIDS = CENTROIDS + f""",
scored AS (SELECT v.row_id, v.label, {dot('v.vec', 'c.centroid')} AS sim FROM vecs v JOIN centroids c USING (label)),
best AS (
  SELECT label, row_id, sim, count(*) OVER (PARTITION BY label) AS size FROM scored
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY sim DESC, row_id) = 1)"""

KNN = EMBEDDINGS + f""",
sims AS (SELECT a.row_id AS src, b.row_id AS dst, {dot('a.vec', 'b.vec')} AS sim FROM vecs a JOIN vecs b ON a.row_id <> b.row_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims QUALIFY rank <= 29)"""
# Each pair of `scored`(low, high, sim) is scored once; one that both ends list appears twice among the listed.
LISTED_TWICE = """,
sides AS (SELECT low AS src, high AS dst, sim FROM scored UNION ALL SELECT high, low, sim FROM scored),
listed AS MATERIALIZED (
  SELECT src, dst, sim FROM sides QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 29),
mutual AS (
  SELECT low AS src, high AS dst, max(sim) AS sim
  FROM (SELECT least(src, dst) AS low, greatest(src, dst) AS high, sim FROM listed) GROUP BY low, high HAVING count(*) = 2)"""
MUTUAL = KNN + """,
mutual AS (
  SELECT a.src, a.dst, a.sim FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src
  WHERE a.sim >= {floor} AND a.src < a.dst)"""
COMPONENTS = """,
ends AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
reach(node, seen) AS (
  SELECT src, src FROM ends UNION SELECT r.node, e.dst FROM reach r JOIN ends e ON e.src = r.seen),
parts_of AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""

# The leaders of `ordered`(row_id, near), where near lists the earlier rows at or above the threshold.
LEADERS = """,
walk(place, leaders) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.place + 1,
         CASE WHEN list_has_any(w.leaders, o.near) THEN w.leaders ELSE list_append(w.leaders, o.row_id) END
  FROM walk w JOIN ordered o ON o.place = w.place + 1),
leads AS (SELECT unnest(leaders) AS leader FROM walk WHERE place = (SELECT max(place) FROM walk))"""

# Places of the mentions' entities, keyed by `key`, over the sentences of `seen`.
COOCCUR = """,
total AS (SELECT count(DISTINCT clean_mention_sentence) AS n FROM {hits}),
seen AS (
  SELECT *, {key} AS key FROM numbered
  WHERE clean_mention_sentence IN (SELECT clean_mention_sentence FROM {hits})),
forms AS (
  SELECT key, clean_entity_mention AS form, count(*) AS n, min(row_id) AS first FROM seen GROUP BY ALL),
shown AS (SELECT key, first(form ORDER BY n DESC, first) AS display FROM forms GROUP BY key)
SELECT s.display AS entity_mention, count(DISTINCT clean_mention_sentence) AS absolute_count,
       round(count(DISTINCT clean_mention_sentence) / any_value(total.n) * 100.0, 6) AS frequency_pct,
       row_number() OVER (ORDER BY count(DISTINCT clean_mention_sentence) DESC, min(row_id)) - 1 AS place
FROM seen JOIN shown s USING (key), total GROUP BY s.key, s.display"""

NETWORK = """,
seen AS (
  SELECT *, {key} AS key FROM (SELECT *, {label} AS form FROM numbered)
  WHERE clean_mention_sentence IN (SELECT clean_mention_sentence FROM {hits})),
forms AS (SELECT key, form, count(*) AS n, min(row_id) AS first FROM seen GROUP BY ALL),
shown AS (SELECT key, first(form ORDER BY n DESC, first) AS display FROM forms GROUP BY key),
pairs AS (SELECT DISTINCT clean_mention_sentence AS sentence, key FROM seen),
top AS (SELECT key, count(*) AS weight FROM pairs GROUP BY key ORDER BY weight DESC, key LIMIT {nodes})"""
NODES = NETWORK + """
SELECT display AS label, weight, greatest(300, least(3000, weight * 300)) AS size FROM top JOIN shown USING (key)"""
EDGES = NETWORK + """,
linked AS (
  SELECT a.key AS a, b.key AS b, count(*) AS weight
  FROM pairs a JOIN pairs b ON a.sentence = b.sentence AND a.key < b.key
  WHERE a.key IN (SELECT key FROM top) AND b.key IN (SELECT key FROM top) GROUP BY a.key, b.key)
SELECT u.display AS u, v.display AS v, weight,
       round(greatest(1.0, CAST(weight AS DOUBLE) / (SELECT max(weight) FROM linked) * 4.0), 6) AS width
FROM linked JOIN shown u ON u.key = linked.a JOIN shown v ON v.key = linked.b"""
_PLAIN, _FOLDED = "clean_entity_mention", "lower(clean_entity_mention)"

# Tagged tokens of the sentences and the spans they make.
SPANS = SENTENCES + """,
tokens AS (
  SELECT doc_id, sentence_no, sentence, tok_idx, length(word) AS size,
         CASE WHEN length(word) <= 2 THEN 'O' WHEN length(word) = 3 THEN 'B-PER' WHEN length(word) <= 5 THEN 'I-PER'
              WHEN length(word) <= 7 THEN 'B-LOC' WHEN length(word) <= 9 THEN 'I-LOC' ELSE 'ORG' END AS label
  FROM (SELECT doc_id, sentence_no, sentence, unnest(a) AS word, generate_subscripts(a, 1) AS tok_idx
        FROM (SELECT *, string_split(sentence, ' ') AS a FROM sentences))),
placed AS (
  SELECT *, coalesce(sum(size + 1) OVER (PARTITION BY doc_id, sentence_no ORDER BY tok_idx
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM tokens),
runs AS (
  SELECT *, count(*) FILTER (label = 'O' OR size = 0) OVER (PARTITION BY doc_id, sentence_no ORDER BY tok_idx) AS run
  FROM placed),
tagged AS (
  SELECT *, string_split(label, '-')[-1] AS type, NOT starts_with(label, 'I-') AS opens,
         row_number() OVER (PARTITION BY doc_id, sentence_no, run ORDER BY tok_idx) = 1 AS begins
  FROM runs WHERE label <> 'O' AND size > 0),
typed AS (
  SELECT *, last_value(CASE WHEN begins OR opens THEN type END IGNORE NULLS) OVER (
           PARTITION BY doc_id, sentence_no, run ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open
  FROM tagged),
counted AS (
  SELECT *, count(*) FILTER (begins OR (opens AND type <> open)) OVER (PARTITION BY doc_id, sentence_no ORDER BY tok_idx) AS e
  FROM typed),
spans AS (
  SELECT doc_id, sentence_no, any_value(sentence) AS sentence, min(s) AS s, arg_max(s + size, tok_idx) AS t,
         arg_min(type, tok_idx) AS type
  FROM counted GROUP BY doc_id, sentence_no, e)"""
ENTITIES = SPANS + """,
entities AS (
  SELECT doc_id, sentence_no, sentence, CAST(s AS BIGINT) AS mention_start, CAST(t AS BIGINT) AS mention_end, type AS entity_type,
         substr(sentence, CAST(s + 1 AS BIGINT), CAST(t - s AS BIGINT)) AS clean_entity_mention
  FROM spans WHERE length(trim(substr(sentence, CAST(s + 1 AS BIGINT), CAST(t - s AS BIGINT)), """ + _BLANKS + ")) > 0)"


def _nulls(column: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    return f"CASE WHEN CAST({column} AS VARCHAR) NOT IN ({tokens}) THEN CAST({column} AS VARCHAR) END AS {column}"


def _rows(prelude: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{prelude}\n{select}"


_ORDER = "document_id, sentence_no, mention_start, clean_entity_mention"

ORACLES: dict[str, str] = {
    "clean_text": _rows(DOCS, "SELECT doc_id, clean FROM docs"),
    "abbreviations": _rows(DOCS + ABBREVIATIONS, "SELECT word, dotted, plain FROM abbreviations"),
    "split_sentences_abbreviations": _rows(
        SENTENCES
        + ABBREVIATIONS
        + """,
ends AS (
  SELECT doc_id, i, s, coalesce(lower(regexp_extract(s, '(?:^|[^\\p{L}])([A-Za-zÀ-ÿ]+)\\.$', 1)) IN (SELECT word FROM abbreviations), false) AS on
  FROM (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM parts)),
grouped AS (
  SELECT *, sum(CASE WHEN coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS no
  FROM (SELECT *, lag(ends.on) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM ends)),
whole AS (SELECT doc_id, no, string_agg(s, ' ' ORDER BY i) AS s FROM grouped GROUP BY doc_id, no)""",
        f"""SELECT doc_id, CAST(no - 1 AS BIGINT) AS sentence_no, trim(s, {_BLANKS}) AS sentence
FROM whole WHERE length(trim(s, {_BLANKS})) > 0""",
    ),
    "split_sentences": _rows(SENTENCES, "SELECT doc_id, sentence_no, sentence FROM sentences"),
    "gazetteer_mentions": _rows(
        MENTIONS,
        """SELECT document_id, source_language, sentence_no, clean_mention_sentence, clean_entity_mention,
       mention_start, mention_end, entity_type FROM mentions""",
    ),
    "merge_tag_spans": _rows(
        SPANS,
        """SELECT doc_id, sentence_no, CAST(s AS BIGINT) AS mention_start, CAST(t AS BIGINT) AS mention_end,
       type AS entity_type FROM spans""",
    ),
    "tag_mentions": _rows(
        ENTITIES, "SELECT doc_id, sentence_no, clean_entity_mention, mention_start, mention_end, entity_type FROM entities"
    ),
    "prepare_folder": _rows(
        ENTITIES,
        """SELECT doc_id, sentence AS clean_mention_sentence, clean_entity_mention, mention_start, mention_end, entity_type
FROM entities""",
    ),
    "map_schema": "SELECT doc_id AS document_id, text AS clean_mention_sentence, lang, source, n_chars FROM documents",
    "read_delimited": "SELECT " + ", ".join(_nulls(c) for c in ("conv_id", "turn", "role")) + ", '  ' || text || ' ' AS text FROM conversations",
    "load_mentions": _rows(
        MENTIONS,
        """SELECT clean_mention_sentence, clean_entity_mention, mention_start, mention_end, entity_type,
       CAST(document_id AS VARCHAR) AS document_id, CAST(sentence_no AS VARCHAR) AS sentence_no, true AS dense
FROM mentions""",
    ),
    "mention_context": _rows(CONTEXTS, f"SELECT {_ORDER}, mention, context FROM rows"),
    "mention_context_fallback": _rows(
        CONTEXTS,
        """SELECT document_id, sentence_no, mention_start, clean_entity_mention AS entity,
       CASE WHEN source_language IN ('de', 'es') THEN clean_mention_sentence ELSE clean_entity_mention END AS mention,
       CASE WHEN source_language IN ('fr', 'de', 'es') THEN clean_mention_sentence ELSE context END AS context
FROM rows""",
    ),
    "encode_hashed": _rows(
        CONTEXTS
        + encoded("e", "SELECT mention AS item FROM rows UNION SELECT context FROM rows")
        + ", ids AS (SELECT item, vec, row_number() OVER (ORDER BY item) - 1 AS row_id FROM e)",
        long_form("ids"),
    ),
    "encode_distinct": _rows(
        MENTION_VECS,
        """SELECT document_id, sentence_no, mention_start, mention, dim, round(CAST(x AS DOUBLE), 6) AS value
FROM (SELECT *, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM rows JOIN m ON m.item = rows.mention) WHERE x <> 0""",
    ),
    "l2_normalize": _rows(
        """tripled AS (SELECT vec_id AS row_id, [CAST(x * CAST(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 3 END AS FLOAT) AS FLOAT) for x in embedding] AS v
                    FROM embeddings),
unit AS (SELECT row_id, [CAST(x / CASE WHEN length > 0 THEN length ELSE 1 END AS FLOAT) for x in v] AS vec
         FROM (SELECT row_id, v, sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS length FROM tripled))""",
        long_form("unit"),
    ),
    "blend_vectors": _rows(BLENDS, long_form("blends")),
    "mean_pool": """WITH cells AS (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS dim,
         CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS mask
  FROM embeddings)
SELECT label AS text_id, dim, round(sum(x * mask) / greatest(sum(mask), 1e-9), 6) AS value FROM cells GROUP BY label, dim""",
    "pca_reduce": _rows(
        EMBEDDINGS
        + """,
cells AS (SELECT row_id, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM vecs),
middle AS (SELECT dim, avg(x) AS m FROM cells GROUP BY dim),
centred AS (SELECT row_id, list(x - m ORDER BY dim) AS v FROM cells JOIN middle USING (dim) GROUP BY row_id)""",
        """SELECT a.row_id, round(list_cosine_similarity(a.v, b.v), 4) AS cosine
FROM centred a JOIN centred b ON b.row_id = a.row_id + 1""",
    ),
    "topk_reduced": _rows(
        EMBEDDINGS
        + """,
cells AS (SELECT row_id, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM vecs),
middle AS (SELECT dim, avg(x) AS m FROM cells GROUP BY dim),
centred AS (SELECT row_id, list(x - m ORDER BY dim) AS v FROM cells JOIN middle USING (dim) GROUP BY row_id),
scores AS (
  SELECT a.row_id AS query_id, b.row_id, round(list_cosine_similarity(a.v, b.v), 6) AS score
  FROM centred a JOIN centred b ON a.row_id % 50 = 0 AND b.row_id >= 0)"""
        + hits("10", 0.1),
        "SELECT query_id, rank, row_id, round(similarity_score, 4) AS similarity_score FROM hits",
    ),
    "cosine_pairs": _rows(
        BOTH_VECS,
        f"""SELECT {_ORDER}, {dot('m.vec', 'c.vec')} AS cosine
FROM rows r JOIN m ON m.item = r.mention JOIN c ON c.item = r.context""",
    ),
    "topk_query": _rows(
        WORD_SCORES + hits("10", 0.50),
        """SELECT query_id, rank, row_id, similarity_score, clean_mention_sentence, clean_entity_mention
FROM hits JOIN rows USING (row_id)""",
    ),
    "topk_own_limits": _rows(
        WORD_SCORES
        + ", limited AS (SELECT s.*, length(a.term) AS k FROM scores s JOIN asked a USING (query_id))"
        + hits("k", 0.6, "limited"),
        "SELECT query_id, rank, row_id, similarity_score FROM hits",
    ),
    "topk_combined": _rows(
        CENTROIDS
        + f", scores AS (SELECT c.label AS query_id, v.row_id, {dot('c.centroid', 'v.vec')} AS score FROM centroids c, vecs v)"
        + hits("10", 0.3),
        "SELECT query_id, rank, row_id, similarity_score FROM hits",
    ),
    "similar_sentences": _rows(
        CONTEXT_SCORES,
        """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank, row_id,
       score AS similarity_score, document_id, clean_mention_sentence, clean_entity_mention, source_language
FROM scores JOIN rows USING (row_id) QUALIFY rank <= 20""",
    ),
    "rerank": _rows(
        CONTEXT_SCORES
        + """,
first_pool AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS spot FROM scores QUALIFY spot <= 40),
bags AS (
  SELECT p.query_id, p.row_id, p.score,
         list_distinct([w for w in regexp_split_to_array(lower(b.text), '[^\\p{L}\\p{N}]+') if w <> '']) AS t,
         list_distinct([w for w in regexp_split_to_array(lower(r.clean_mention_sentence), '[^\\p{L}\\p{N}]+') if w <> '']) AS s
  FROM first_pool p JOIN benchmark b ON b.item_id = p.query_id JOIN rows r USING (row_id)),
fresh AS (
  SELECT query_id, row_id, score AS old,
         coalesce(CAST(len(list_intersect(t, s)) AS DOUBLE) / nullif(len(list_distinct(list_concat(t, s))), 0), 0) AS new
  FROM bags),
rescored AS (
  SELECT query_id, row_id,
         CASE WHEN max(new) OVER w > min(new) OVER w
              THEN (new - min(new) OVER w) / (max(new) OVER w - min(new) OVER w) ELSE old END AS score
  FROM fresh WINDOW w AS (PARTITION BY query_id))"""
        + hits("10", 0.50, "rescored"),
        "SELECT query_id, rank, row_id, round(similarity_score, 6) AS similarity_score FROM hits",
    ),
    "result_view": _rows(
        WORD_SCORES + hits("10", 0.50),
        """SELECT query_id, rank, round(similarity_score, 4) AS score, CAST(document_id AS VARCHAR) AS source,
       'N/A' AS cluster, clean_entity_mention AS medoid, clean_entity_mention AS entity_mention,
       clean_mention_sentence AS sentence, substr(clean_mention_sentence, 1, 80) || '...' AS preview, source_language
FROM hits JOIN rows USING (row_id)""",
    ),
    "knn_graph": _rows(KNN, "SELECT src, dst, sim, rank FROM knn"),
    "knn_graph_copies": _rows(
        MENTION_VECS
        + f""",
near AS (SELECT a.item AS a, b.item AS b, {dot('a.vec', 'b.vec')} AS sim FROM m a, m b)""",
        """SELECT x.row_id AS src, y.row_id AS dst, sim,
       row_number() OVER (PARTITION BY x.row_id ORDER BY sim DESC, y.row_id) AS rank
FROM rows x JOIN near ON near.a = x.mention JOIN rows y ON y.mention = near.b AND y.row_id <> x.row_id
QUALIFY rank <= 29""",
    ),
    "mutual_knn_edges": _rows(
        EMBEDDINGS
        + f""",
scored AS MATERIALIZED (
  SELECT a.row_id AS low, b.row_id AS high, {dot('a.vec', 'b.vec')} AS sim FROM vecs a JOIN vecs b ON a.row_id < b.row_id)"""
        + LISTED_TWICE,
        "SELECT src, dst, sim FROM mutual WHERE sim >= 0.35",
    ),
    "mutual_knn_edges_mentions": _rows(
        # Single precision sorts out nearly all pairs before the exact score.
        BLENDS
        + f""",
held AS MATERIALIZED (SELECT row_id, vec, CAST(vec AS FLOAT[{_DIM}]) AS quick FROM blends),
near AS MATERIALIZED (
  SELECT a.row_id AS low, b.row_id AS high FROM held a JOIN held b ON a.row_id < b.row_id
  WHERE array_inner_product(a.quick, b.quick) >= 0.699),
scored AS MATERIALIZED (
  SELECT * FROM (
    SELECT low, high, {dot('a.vec', 'b.vec')} AS sim FROM near JOIN held a ON a.row_id = low JOIN held b ON b.row_id = high)
  WHERE sim >= 0.7)"""
        + LISTED_TWICE,
        "SELECT src, dst, sim FROM mutual",
    ),
    "connected_components": _rows(
        MENTIONS
        + """,
nos AS (SELECT term, -row_number() OVER (ORDER BY term) AS no FROM (SELECT DISTINCT clean_entity_mention AS term FROM mentions)),
links AS (SELECT DISTINCT document_id AS src, no AS dst FROM mentions JOIN nos ON nos.term = clean_entity_mention)"""
        + COMPONENTS,
        "SELECT node, component FROM parts_of",
        recursive=True,
    ),
    "cluster_mutual_knn": _rows(
        MUTUAL.replace("{floor}", "0.35") + ", links AS (SELECT src, dst FROM mutual)" + COMPONENTS
        + """,
named AS (
  SELECT v.row_id, coalesce(p.component, v.row_id) AS c FROM vecs v LEFT JOIN parts_of p ON p.node = v.row_id)""",
        "SELECT row_id, dense_rank() OVER (ORDER BY c) - 1 AS cluster_id FROM named",
        recursive=True,
    ),
    # One merge at a time: the two clusters of the most similar means, of equal ones the first.
    "cluster_agglomerative": _rows(
        EMBEDDINGS
        + f""",
state(step, id, vec, size, members) AS (
  SELECT 0, row_id, vec, 1, [row_id] FROM vecs
  UNION ALL
  (WITH now AS (SELECT * FROM state),
   best AS (
     SELECT a.id AS one, b.id AS two, [(a.vec[i] * a.size + b.vec[i] * b.size) / (a.size + b.size) for i in range(1, len(a.vec) + 1)] AS mean,
            b.size AS more, b.members AS others
     FROM now a JOIN now b ON a.id < b.id WHERE {dot('a.vec', 'b.vec')} > 0.35
     ORDER BY {dot('a.vec', 'b.vec')} DESC, a.id, b.id LIMIT 1)
   SELECT step + 1, id, CASE WHEN id = one THEN mean ELSE vec END, CASE WHEN id = one THEN size + more ELSE size END,
          CASE WHEN id = one THEN list_concat(members, others) ELSE members END
   FROM now, best WHERE id <> two)),
ended AS (SELECT id, unnest(members) AS row_id FROM state WHERE step = (SELECT max(step) FROM state))""",
        "SELECT row_id, dense_rank() OVER (ORDER BY id) - 1 AS cluster_id FROM ended",
        recursive=True,
    ),
    "cluster_leader": _rows(
        EMBEDDINGS
        + f""",
sims AS (
  SELECT a.row_id, b.row_id AS other, {dot('a.vec', 'b.vec')} AS sim FROM vecs a JOIN vecs b ON b.row_id < a.row_id),
near AS (SELECT row_id, list(other) AS near FROM sims WHERE sim >= 0.35 GROUP BY row_id),
ordered AS (
  SELECT v.row_id, row_number() OVER (ORDER BY v.row_id) AS place, coalesce(near, []) AS near
  FROM vecs v LEFT JOIN near USING (row_id))"""
        + LEADERS
        + """,
followed AS (
  SELECT row_id, other AS leader FROM sims JOIN leads ON leads.leader = sims.other WHERE sim >= 0.35
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY sim DESC, other) = 1)""",
        """SELECT row_id, dense_rank() OVER (ORDER BY coalesce(leader, row_id)) - 1 AS cluster_id
FROM vecs LEFT JOIN followed USING (row_id)""",
        recursive=True,
    ),
    "cluster_leader_mentions": _rows(
        MENTION_VECS
        + f""",
firsts AS (SELECT min(row_id) AS row_id, vec FROM rows JOIN m ON m.item = rows.mention GROUP BY vec),
sims AS (
  SELECT a.row_id, b.row_id AS other, {dot('a.vec', 'b.vec')} AS sim FROM firsts a JOIN firsts b ON b.row_id < a.row_id),
near AS (SELECT row_id, list(other) AS near FROM sims WHERE sim >= 0.7 GROUP BY row_id),
ordered AS (
  SELECT f.row_id, row_number() OVER (ORDER BY f.row_id) AS place, coalesce(near, []) AS near
  FROM firsts f LEFT JOIN near USING (row_id))"""
        + LEADERS
        + f""",
lead_vecs AS (SELECT f.row_id AS leader, f.vec FROM firsts f JOIN leads ON leads.leader = f.row_id),
close AS (SELECT m.item, l.leader, {dot('m.vec', 'l.vec')} AS sim FROM m, lead_vecs l),
followed AS (
  SELECT r.row_id, c.leader FROM rows r JOIN close c ON c.item = r.mention AND c.leader <= r.row_id WHERE c.sim >= 0.7
  QUALIFY row_number() OVER (PARTITION BY r.row_id ORDER BY c.leader = r.row_id DESC, c.sim DESC, c.leader) = 1)""",
        "SELECT row_id, dense_rank() OVER (ORDER BY leader) - 1 AS cluster_id FROM followed",
        recursive=True,
    ),
    # Single precision sorts out nearly all pairs before the exact score.
    "build_index_whole_vectors": _rows(
        BLENDS
        + f""",
held AS MATERIALIZED (SELECT row_id, vec, CAST(vec AS FLOAT[{_DIM}]) AS quick FROM blends),
firsts AS MATERIALIZED (SELECT min(row_id) AS row_id, vec, quick FROM held GROUP BY vec, quick),
pairs AS MATERIALIZED (
  SELECT a.row_id, b.row_id AS other FROM firsts a JOIN firsts b ON b.row_id < a.row_id
  WHERE array_inner_product(a.quick, b.quick) >= 0.699),
near AS (
  SELECT p.row_id, list(p.other) AS near FROM pairs p JOIN firsts a ON a.row_id = p.row_id JOIN firsts b ON b.row_id = p.other
  WHERE {dot('a.vec', 'b.vec')} >= 0.7 GROUP BY p.row_id),
ordered AS MATERIALIZED (
  SELECT f.row_id, row_number() OVER (ORDER BY f.row_id) AS place, coalesce(near, []) AS near
  FROM firsts f LEFT JOIN near USING (row_id))"""
        + LEADERS
        + f""",
lead_vecs AS MATERIALIZED (SELECT f.row_id AS leader, f.vec, f.quick FROM firsts f JOIN leads ON leads.leader = f.row_id),
close AS (
  SELECT h.row_id, l.leader, {dot('h.vec', 'l.vec')} AS sim FROM held h JOIN lead_vecs l ON l.leader <= h.row_id
  WHERE array_inner_product(h.quick, l.quick) >= 0.699),
followed AS (
  SELECT row_id, leader FROM close WHERE sim >= 0.7
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY leader = row_id DESC, sim DESC, leader) = 1),
clusters AS MATERIALIZED (SELECT row_id, dense_rank() OVER (ORDER BY leader) - 1 AS cluster_id FROM followed),
cells AS (SELECT cluster_id, unnest(vec) AS x, unnest(range({_DIM})) AS dim FROM clusters JOIN held USING (row_id)),
means AS (SELECT cluster_id, list(m ORDER BY dim) AS v FROM (SELECT cluster_id, dim, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY cluster_id, dim) GROUP BY cluster_id),
middles AS (SELECT cluster_id, [x / length for x in v] AS centroid FROM (SELECT cluster_id, v, sqrt(list_dot_product(v, v)) AS length FROM means)),
best AS (
  SELECT cluster_id, row_id AS medoid FROM clusters JOIN held USING (row_id) JOIN middles USING (cluster_id)
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY {dot('vec', 'centroid')} DESC, row_id) = 1)""",
        """SELECT r.row_id, r.clean_mention_sentence, r.clean_entity_mention, r.mention, c.cluster_id, m.mention AS cluster_canonical_mention
FROM rows r JOIN clusters c USING (row_id) JOIN best b ON b.cluster_id = c.cluster_id JOIN rows m ON m.row_id = b.medoid""",
        recursive=True,
    ),
    "cluster_medoids": _rows(
        MEDOIDS,
        """SELECT v.row_id, CAST(v.label AS BIGINT) AS cluster_id, 'vec-' || b.row_id AS cluster_canonical_mention
FROM vecs v JOIN best b USING (label)""",
    ),
    "medoid_scores": _rows(
        MEDOIDS,
        """SELECT CAST(label AS BIGINT) AS cluster_id, row_id AS medoid_row, 'vec-' || row_id AS medoid_mention,
       sim AS similarity, size FROM best""",
    ),
    "cluster_stats": """SELECT size, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS rows
FROM (SELECT label, count(*) AS size FROM embeddings GROUP BY label) GROUP BY size""",
    "cooccurring_entities": _rows(MENTIONS + COOCCUR.format(key=_PLAIN, hits="numbered"), ""),
    "cooccurring_entities_ci": _rows(MENTIONS + COOCCUR.format(key=_FOLDED, hits="numbered"), ""),
    "cooccurring_of_hits": _rows(
        WORD_SCORES + hits("10", 0.50) + ", found AS (SELECT clean_mention_sentence FROM hits JOIN rows USING (row_id))"
        + COOCCUR.format(key=_PLAIN, hits="found"),
        "",
    ),
    "network_nodes": _rows(MENTIONS + NODES.format(key="form", label=_PLAIN, hits="numbered", nodes=25), ""),
    "network_nodes_ci": _rows(MENTIONS + NODES.format(key="lower(form)", label=_PLAIN, hits="numbered", nodes=25), ""),
    "network_edges": _rows(MENTIONS + EDGES.format(key="form", label=_PLAIN, hits="numbered", nodes=25), ""),
    "network_edges_of_hits": _rows(
        WORD_SCORES + hits("10", 0.50) + ", found AS (SELECT clean_mention_sentence FROM hits JOIN rows USING (row_id))"
        + EDGES.format(key="lower(form)", label=_PLAIN, hits="found", nodes=100),
        "",
    ),
    "network_edges_medoids": _rows(
        MENTIONS
        + EDGES.format(key="form", label="upper(substr(clean_entity_mention, 1, 3))", hits="numbered", nodes=25),
        "",
    ),
    "index_roundtrip": _rows(
        BLENDS,
        """SELECT source_language AS corpus_id, row_id, clean_entity_mention, dim, round(CAST(x AS DOUBLE), 6) AS value
FROM (SELECT row_id, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM blends) JOIN numbered USING (row_id) WHERE x <> 0""",
    ),
    "corpus_stats": _rows(
        MENTIONS
        + ", counts AS (SELECT source_language AS corpus_id, count(*) AS n FROM mentions GROUP BY ALL)",
        """SELECT lang AS corpus_id, upper(lang) AS name, coalesce(n, 0) AS rows, n IS NOT NULL AS indexed
FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN counts ON corpus_id = lang""",
    ),
    "stream_answers": _rows(
        MENTION_VECS
        + TEXT_QUERIES
        + f""",
texts AS (SELECT b.item_id AS query_id, m.item, {dot('q.vec', 'm.vec')} AS score FROM benchmark b JOIN q ON q.item = b.text, m),
scores AS (SELECT t.query_id, r.row_id, t.score FROM texts t JOIN rows r ON r.mention = t.item)"""
        + hits("5", 0.2),
        "SELECT query_id, rank, row_id, similarity_score FROM hits",
    ),
}
ORACLES["mutual_knn_edges_bounded"] = ORACLES["mutual_knn_edges_mentions"]
ORACLES["topk_blocks"] = ORACLES["topk_query"]
