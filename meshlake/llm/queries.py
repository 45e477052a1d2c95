"""Registered queries of the corpus operators, with DuckDB counterparts where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, licenses, mixing, negatives, pieces, pii, quality, sharding, suffixes, tokenfile, toolcalls, topk, trie
from .common import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS)) + "]"

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
 g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 p AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
 c AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
              length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
              len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet_lines,
              len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\r]*$'))) AS n_ellipsis_lines,
              len(list_distinct(list_filter(w, lambda x: list_contains({_STOPS_SQL}, x)))) AS n_stop_words,
              coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN p USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars BETWEEN 2 * n_words AND 14 * n_words
       AND n_symbols <= 0.1::DOUBLE * n_words AND n_stop_words >= 2 AND n_dup_lines <= 0.6::DOUBLE * n_lines
       AND n_bullet_lines <= 0.9::DOUBLE * n_lines AND n_ellipsis_lines <= 0.3::DOUBLE * n_lines AS kept
FROM c"""


@query("op4_quality_rules", QUALITY_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the contract's base test and the verdict of the rule table."""
    df = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                     (~base & F.col("passed")).alias("kept"))


def _time_sql(part: str, schedule) -> str:
    total, done, arms = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)), 0.0, []
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False):
        slope, need = (r1 - r0) / (t1 - t0), f"({part} * {total!r}::DOUBLE - {done!r}::DOUBLE)"
        done += (t1 - t0) * (r0 + r1) / 2
        arms.append(f"WHEN {part} * {total!r}::DOUBLE <= {done!r}::DOUBLE THEN {t0!r}::DOUBLE + 2 * {need} / ({r0!r}::DOUBLE + "
                    f"sqrt(greatest({r0 * r0!r}::DOUBLE + 2 * {slope!r}::DOUBLE * {need}, 0::DOUBLE)))")
    return f"CASE {' '.join(arms)} ELSE 1 END"


def _at_sql(start: str) -> str:
    part = f"(({start}) / target)"
    return "CASE " + " ".join(f"WHEN weight = {w} THEN {_time_sql(part, s)}" for w, s in mixing.SCHEDULES.items()) + " END"


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL}) AS size FROM documents),
 s0 AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
 s1 AS (SELECT *, (2 * source_size)::DOUBLE AS room, (2 * source_size)::DOUBLE / weight AS full_at FROM s0),
 s2 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(room) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s1 WINDOW f AS (ORDER BY full_at, encode(source) NULLS LAST)),
 s AS (SELECT source, source_size, weight, least(room, (SELECT max(lev) FROM s2) * weight) AS target FROM s2),
 o AS (SELECT d.*, s.source_size, s.weight, s.target, round(s.target)::BIGINT AS goal,
              coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size), doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
       FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
 p AS (SELECT *, greatest(0, least(size, goal - start))::BIGINT AS n1, greatest(0, least(size, goal - source_size - start))::BIGINT AS n2 FROM o)
SELECT doc_id, size::BIGINT AS size, source_size, target, n1 + n2 AS taken,
       round(CASE WHEN n1 > 0 THEN {_at_sql("start")} END, 9) AS at_first, round(CASE WHEN n2 > 0 THEN {_at_sql("start + source_size")} END, 9) AS at_second
FROM p"""


@query("op3_mixing_sources", MIX_SQL)
def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the curriculum takes of every document, and when; documents that take none come last."""
    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("doc_id", "size", "source_size", "target", "taken", F.round("at_first", 9).alias("at_first"), F.round("at_second", 9).alias("at_second")) \
            .orderBy(F.col("at_first").asc_nulls_last(), "doc_id")


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 of near equal bytes, and its place in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = sharding.histogram_sort(docs, shards=40)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _template_sql(template: str) -> str:
    out = " "
    for piece in re.findall(r"<<[^<>]*>>|[^<>]+", template):
        if piece == "<<optional>>":
            out += "(?:"
        elif piece == "<<end>>":
            out += ")?"
        elif piece.startswith("<<any"):
            out += f"(?:[^ ]+ ){{0,{piece[6:-2]}}}"
        else:
            out += "".join(w.decode() + " " for w in licenses.words_of(piece))
    return out


def _license_sql() -> str:
    place = "list_filter(range(1, len(w) + 1), lambda i: {})"
    phrases = [(label, place.format(" AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())))) for p, label in licenses.PHRASES.items()]
    base = " || ".join(p for _, p in phrases)
    named = "[" + ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for label, p in phrases) + "]"
    forms = [(label, _template_sql(t), licenses.compiled(label, t).mandatory) for label, t in licenses.TEMPLATES]
    hits = ", ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN {m} END AS m{k}" for k, (_, p, m) in enumerate(forms))
    more = "[" + ", ".join(f"CASE WHEN m{k} IS NOT NULL THEN '{label}' END" for k, (label, _, _) in enumerate(forms)) + "]"
    covered = "greatest(0, " + ", ".join(f"coalesce(m{k}, 0)" for k in range(len(forms))) + ")"
    join = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 p AS (SELECT doc_id, w, {base} AS base, {named} AS named, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
 m AS (SELECT *, {hits} FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(base)::BIGINT AS n_base, list_min(base) - 1 AS first_word, list_max(base) - 1 AS last_word,
       {join.format("named")} AS base_labels, {join.format(f"named || {more}")} AS labels,
       greatest(least(1.0, {covered}::DOUBLE / 20), CASE WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM m"""


@query("op9_license_scans", _license_sql())
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places, labels and score of every document."""
    found = licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op2_exact_top_k", TOP_K_SQL)
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors for every 50th one."""
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    model = tokenizer_path("piece_bpe_32k.model")
    df = pieces.transcode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return df.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                     F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum as read back from the written token file."""
    path = shared_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenfile.write_tokens(docs, tokenizer_path("word_bpe_49k.json"), path, end=2)
    back = tokenfile.read_tokens(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                           ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w),
 n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
 i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 e AS (SELECT u, v FROM i JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 85 * (a.n + b.n - i)),
 r AS (SELECT doc_id, doc_id AS to_id FROM n UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.to_id),
 c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id), d AS (SELECT u AS doc_id, count(*) AS n_links FROM e GROUP BY u)
SELECT doc_id, n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM n JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)"""


@query("op1_ngram_jaccard_join", JACCARD_SQL)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component and number of links at a similarity of 0.85 or more over 4-word shingles."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, num=85, den=100)


PASSAGES_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
 r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM g),
 a AS (SELECT doc_id, i, nth, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r WHERE n > 1),
 s AS (SELECT doc_id, i, nth, count(*) FILTER (gap IS NULL OR gap > 50) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM a),
 l AS (SELECT doc_id, span, sum(least(50, coalesce(nxt - i, 50))) AS later FROM (SELECT doc_id, span, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM s WHERE nth > 1) GROUP BY ALL)
SELECT doc_id, min(i)::BIGINT AS start_word, max(i)::BIGINT + 50 AS end_word, max(i)::BIGINT + 50 - min(i)::BIGINT AS n_words, coalesce(any_value(later), 0)::BIGINT AS later_words
FROM s LEFT JOIN l USING (doc_id, span) GROUP BY doc_id, span"""


@query("op6_suffix_dedup", PASSAGES_SQL)
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that occurs again, and how many of its words have an earlier occurrence."""
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), least=50)
    one = found.select("doc_id", F.explode("spans").alias("s"), "later")
    inside = F.filter("later", lambda x: (x["start"] >= F.col("s.start")) & (x["end"] <= F.col("s.end")))
    words = F.aggregate(inside, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return one.select("doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), (F.col("s.end") - F.col("s.start")).alias("n_words"), words.alias("later_words"))


TOOLS_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, to_json(text)::VARCHAR AS j FROM conversations),
 call AS (SELECT conv_id, turn, text, j, 'call-' || turn AS id, CASE WHEN turn >= 2 THEN 'call-' || (turn - 2) END AS prior FROM t WHERE role = 'user'),
 answer AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content FROM t WHERE role IN ('assistant', 'tool') GROUP BY ALL),
 ids AS (SELECT DISTINCT conv_id, turn FROM call),
 lev AS (SELECT conv_id, turn, 0 AS level FROM ids i WHERE NOT EXISTS (SELECT 1 FROM ids p WHERE p.conv_id = i.conv_id AND p.turn = i.turn - 2)
         UNION ALL SELECT i.conv_id, i.turn, level + 1 FROM lev JOIN ids i ON i.conv_id = lev.conv_id AND i.turn = lev.turn + 2),
 c AS (SELECT c.conv_id, turn, level, content, a.turn IS NOT NULL AS answered, length(text) BETWEEN 1 AND 600 AS fine,
              '{"arguments":{' || CASE WHEN turn >= 2 THEN '"follows":"' || prior || '",' ELSE '' END || '"prompt":' || j || ',"turn":' || turn || '},"faults":['
              || CASE WHEN length(text) BETWEEN 1 AND 600 THEN '' ELSE '"prompt"' END || '],"id":"' || id || '","name":"reply","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS m
       FROM call c LEFT JOIN lev USING (conv_id, turn) LEFT JOIN answer a USING (conv_id, turn)),
 o AS (SELECT a.conv_id, a.turn, '{"id":"call-' || a.turn || '","result":' || to_json(content) || '}' AS m FROM answer a ANTI JOIN ids USING (conv_id, turn)),
 x AS (SELECT conv_id, turn, '{"content":' || j || ',"role":' || to_json(role) || '}' AS m FROM t WHERE role NOT IN ('user', 'assistant', 'tool')),
 k AS (SELECT DISTINCT conv_id FROM t),
 cs AS (SELECT conv_id, count(*) AS n_calls, count(*) FILTER (answered) AS n_linked, count(*) FILTER (NOT fine) AS n_invalid, max(level) + 1 AS depth,
               string_agg(m, ',' ORDER BY level, turn, m) AS m FROM c GROUP BY conv_id),
 os AS (SELECT conv_id, count(*) AS n, string_agg(m, ',' ORDER BY 'call-' || turn, m) AS m FROM o GROUP BY conv_id),
 xs AS (SELECT conv_id, string_agg(m, ',' ORDER BY turn, m) AS m FROM x GROUP BY conv_id)
SELECT conv_id, coalesce(n_calls, 0) AS n_calls, coalesce(n_linked, 0) AS n_linked, coalesce(n_invalid, 0) AS n_invalid, 0::BIGINT AS n_cyclic, coalesce(os.n, 0) AS n_orphans,
       coalesce(depth, 0)::INTEGER AS depth, '{"calls":[' || coalesce(cs.m, '') || '],"messages":[' || coalesce(xs.m, '') || '],"orphans":[' || coalesce(os.m, '') || ']}' AS json
FROM k LEFT JOIN cs USING (conv_id) LEFT JOIN os USING (conv_id) LEFT JOIN xs USING (conv_id)"""


@query("op10_tool_call_linking", TOOLS_SQL)
def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns as linked calls and results in canonical JSON."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    calls, results, others = toolcalls.calls_of_turns(turns)
    return toolcalls.conversations_json(toolcalls.linked_calls(calls, results, toolcalls.REPLY), others)


# crc32 of an ASCII string: eight steps a byte, the byte coming in at the first of them
_CRC_SQL = ("xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(range(1, len({0}) + 1), lambda i: [ascii(substr({0}, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))]), "
            "lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)")

TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, m) AS place, m, n
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len({WORDS_SQL}) AS n
                 FROM conversations WHERE conv_id IS NOT NULL)),
 c AS (SELECT conv_id, {_CRC_SQL.format("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS b FROM (SELECT DISTINCT conv_id FROM t)),
 r AS (SELECT c.conv_id, t.place, m, n FROM c JOIN t ON t.conv_id = c.b AND t.place <= h UNION ALL SELECT c.conv_id, t.place, m, n FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > h),
 p AS (SELECT conv_id, row_number() OVER w AS d, md5(string_agg(m, ',') OVER w) AS k, n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT conv_id, d, k, n FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
 v AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM a GROUP BY d, k),
 u AS (SELECT v.*, q.k AS pk, pv.conv_id AS parent FROM v LEFT JOIN a q ON q.conv_id = v.conv_id AND q.d = v.d - 1 LEFT JOIN v pv ON pv.d = q.d AND pv.k = q.k),
 kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
 sub AS (SELECT q.d, q.k, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.n) AS saved
         FROM u LEFT JOIN kids ON kids.d = u.d AND kids.k = u.k JOIN a q ON q.conv_id = u.conv_id AND q.d <= u.d GROUP BY ALL),
 e AS (SELECT d, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max(d) AS d, arg_max(k, d) AS k FROM a GROUP BY conv_id) GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM u LEFT JOIN kids USING (d, k) JOIN sub USING (d, k) LEFT JOIN e USING (d, k)"""


@query("op11_conversation_prefix_trie", TRIE_SQL)
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that share their group's first turns."""
    turns, convs = trie.shared_starts(trie.numbered_turns(table(spark, sf_dir, "conversations")), group=20, variants=4)
    return trie.prefix_trie(turns, convs).drop("enter", "leave")


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
       FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5"""


@query("op13_hard_negative_mining", NEGATIVES_SQL)
def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 100th vector and each of its 5 best of the same label, the 5 best of other labels at 80 to 100 % of its score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256)


@query("op12_personal_data")
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and digest of the spans of rules, and all its spans."""
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: ~s["added"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
