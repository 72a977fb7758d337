"""The text operators bound to the given tables, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    chat, exact_dedup, jaccard, mixing, packing, prefix_trie, quality, secrets, spelling, substrings, token_counts, topk,
    toxicity,
)
from plumbline.llm.common import hold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_substring_dedup")
def substring_query(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents"), "doc_id", "text", window=20).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@query("op2_token_counts")
def token_count_query(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"),
                                        public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op3_exact_top_k", """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0 AND NOT isnan(x)) AS bits FROM embeddings
               WHERE embedding IS NOT NULL),
     pairs AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
                      list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CAST(z[1] <> z[2] AS BIGINT))) AS distance
               FROM codes q JOIN codes r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, neighbor_id, rank, CAST(distance AS BIGINT) AS distance FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
WHERE rank <= 10""")
def top_k_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", topk.sign_code(F.col("embedding"), whole=True).alias("code"))
    return topk.nearest(rows, "code", "vec_id", F.col("vec_id") % 50 == 0, k=10)


@query("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def exact_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.group_equal_texts(table(spark, folder, "documents"), "doc_id", "text", keep="largest")


#: Marginals are the token shares to this power; rounds of raking.
POWER, ROUNDS = 0.7, 8


@query("op5_mixing", mixing.oracle(POWER, ROUNDS))
def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", F.coalesce("source", F.lit("\x00null")).alias("source"),
        F.coalesce("lang", F.lit("\x00null")).alias("lang"), mixing.topic_of(F.col("text")).alias("topic"),
        mixing.token_weight(F.col("text")).alias("n_tokens"))
    # The texts are read and searched once, for the cells and for the rows.
    return mixing.sample_to_targets(hold(docs), ["source", "lang", "topic"], "doc_id", "n_tokens", power=POWER, rounds=ROUNDS)


@query("op6_ngram_jaccard_join")
def jaccard_query(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"), "doc_id", "text", words=4, percent=85)


@query("op7_quality_classifier")
def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")), threshold=0.3)


@query("op8_chat_format", """
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, r)),
     grown AS (SELECT *, replace(replace(text, '%', '%25'), '<', '%3C') AS safe FROM said),
     groups AS (SELECT conv_id, count(*) AS n_turns,
       string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
       coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
       sum(length(replace(replace(role, '%', '%25'), '<', '%3C')) + length(safe) + 23) AS chars
     FROM grown GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars FROM groups""")
def chat_query(spark: SparkSession, folder: str) -> DataFrame:
    added = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), "
                      "(-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    back = chat.read_back(chat.format_conversations(chat.canonical_turns(given.unionByName(added))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


@query("op9_packing")
def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                          size=4096, eos=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op10_toxicity")
def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")), threshold=0.5)


def _crc32_sql(codes: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a list of byte values."""
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: {step})"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda a, b: {byte}), 4294967295)"


_WORD = r"[^\x20\x09-\x0D]+"


@query("op11_conversation_trie", f"""
WITH said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
              WHERE conv_id IS NOT NULL),
     own AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS s FROM said GROUP BY c),
     cut AS (SELECT *, c - c % 20 AS head,
       {_crc32_sql("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(unicode(y) AS BIGINT))")} % 4 AS h FROM own),
     built AS (SELECT a.c, list_concat(CASE WHEN a.h = 0 OR b.s IS NULL THEN [] ELSE b.s[1:a.h] END, a.s[a.h + 1:]) AS s
               FROM cut a LEFT JOIN own b ON a.head = b.c),
     deep AS (SELECT c, d, CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS p, len(s) = d AS stops
              FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM built)),
     node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (stops), '')) AS ends_sha256,
                (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].x, '{_WORD}')) END AS saved
              FROM deep GROUP BY p, d),
     kids AS (SELECT CASE WHEN d = 1 THEN [] ELSE p[1:d - 1] END AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
     whole AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
     below AS (SELECT CASE WHEN u = 0 THEN [] ELSE p[1:u] END AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
               FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM whole) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, below.n_leaves,
       CAST(below.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN below USING (p) LEFT JOIN node up ON w.d > 0 AND up.d = w.d - 1 AND
     up.p = CASE WHEN w.d <= 1 THEN [] ELSE w.p[1:w.d - 1] END""")
def trie_query(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    built = prefix_trie.with_borrowed_starts(prefix_trie.turn_sequences(turns), "conv_id", "turns", block=20, most=3)
    return prefix_trie.prefix_trie(built)


_UTF8 = """flatten(list_transform(string_split({0}, ''), lambda y: CASE WHEN unicode(y) < 128 THEN [CAST(unicode(y) AS BIGINT)]
  ELSE [192 + unicode(y) // 64, 128 + unicode(y) % 64] END))"""


@query("op12_spelling_variants", fr"""
WITH RECURSIVE run AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
       FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
     coded AS (SELECT *, {_crc32_sql(_UTF8.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h
               FROM run WHERE length(run) >= 7),
     counted AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n) AS n
                 FROM coded GROUP BY 1),
     vocab AS MATERIALIZED (SELECT word, CAST(n AS BIGINT) AS n FROM counted WHERE length(word) >= 7 AND n >= 2),
     less AS MATERIALIZED (SELECT word, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM vocab)),
     near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT a.word, v.word FROM less a JOIN vocab v ON a.rest = v.word
              UNION SELECT v.word, a.word FROM less a JOIN vocab v ON a.rest = v.word),
     best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS best_n, arg_min(near.other, (-o.n, near.other)) AS best
              FROM near JOIN vocab o ON o.word = near.other GROUP BY near.word),
     form AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form,
              CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM vocab v LEFT JOIN best USING (word)),
     walk AS (SELECT word, coalesce(form, word) AS at, form IS NULL AS done FROM form
              UNION ALL SELECT w.word, coalesce(f.form, w.at), f.form IS NULL FROM walk w JOIN form f ON f.word = w.at WHERE NOT w.done)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM form f JOIN walk w ON w.word = f.word AND w.done""")
def spelling_query(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_groups(hold(spelling.typo_counts(table(spark, folder, "documents"))))


def _spans_sql(rule: secrets.Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT row, {rank} AS rank, '{rule.kind}' AS kind, start, start + size AS stop FROM (
      SELECT row, size, part, sum(gap + size) OVER (PARTITION BY row ORDER BY i) - size AS start FROM (
        SELECT row, unnest(range(1, len(m) + 1)) AS i, length(m[i]) AS size, length(g[i]) AS part, length(b[i]) AS gap FROM (
          SELECT row, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
            string_split_regex(t, '{pattern}') AS b FROM texts WHERE regexp_matches(t, '{pattern}')))) WHERE part >= {rule.least}"""


_RULES = (*secrets.GIVEN, *secrets.MORE)
_BASE = ", ".join(f"'{r.kind}'" for r in secrets.GIVEN)
_JOINED = "coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank){}, '')"


@query("op13_secret_scan", f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
     found AS ({" UNION ALL ".join(_spans_sql(r, i) for i, r in enumerate(_RULES))}),
     told AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.GIVEN)},
                {_JOINED.format(f" FILTER (kind IN ({_BASE}))")} AS base, {_JOINED.format("")} AS spans FROM found GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.GIVEN)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans FROM texts LEFT JOIN told USING (row)""")
def secret_query(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.GIVEN]
    counts = [secrets.count_kind(F.col("findings"), kind).alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("findings"), base), 256).alias("base_sha256"),
                        secrets.joined(F.col("findings")).alias("spans"))
