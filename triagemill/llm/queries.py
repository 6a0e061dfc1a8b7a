"""Queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether they exceed 512."""
    from triagemill.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_path(), limit=512)


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents concatenated and cut into sequences of 2048 ids."""
    from triagemill.llm.packing import pack

    docs = documents(spark, sf_dir)
    return pack(docs, tokenizer_path(), end_id=1, window=2048, with_ids=False)


@query("op10_huffman_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids written as Huffman-coded frames with their code book, and read back from there."""
    from triagemill.llm.huffman import read_ids, write_ids

    path = write_ids(documents(spark, sf_dir), tokenizer_path(), end_id=2)
    return read_ids(spark, path, with_ids=False)


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1' || coalesce(doc_id::VARCHAR, '')) AS ord,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('=' || source, '~') AS src
  FROM documents),
s AS (SELECT src, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM s),
w2 AS (
  SELECT *, ([3, 1, 2])[no % 3 + 1]::BIGINT AS weight, 2 * source_size AS cap,
         (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total FROM w),
w3 AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w2),
w4 AS (
  SELECT *, (total - (sum(cap) OVER (ORDER BY ratio, no) - cap)::BIGINT)::DOUBLE
            / (sum(weight) OVER (ORDER BY ratio, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT
            AS level FROM w3),
w5 AS (
  SELECT *, CASE WHEN ratio > level
                 THEN weight * arg_min(level, [ratio, no::DOUBLE]) FILTER (ratio > level) OVER ()
                 ELSE cap::DOUBLE END AS target FROM w4),
p1 AS (
  SELECT *, floor((sum(target) OVER ()) / 16 + 0.5)::BIGINT AS seats_all,
         sum(target) OVER () AS votes FROM w5),
q1 AS (
  SELECT src, count(*) AS seats FROM (
    SELECT src, row_number() OVER (ORDER BY q DESC, no) AS rk, seats_all FROM (
      SELECT src, no, seats_all, target / (2 * unnest(range(0, (target * seats_all / votes)::BIGINT + 3)) + 1) AS q
      FROM p1 WHERE votes > 0) u) r
  WHERE rk <= seats_all GROUP BY src),
f AS (
  SELECT p1.src, source_size, target, coalesce(seats, 0) AS seats,
         greatest(least(ceil(source_size / 65536.0), 4096), 1)::BIGINT AS shards
  FROM p1 LEFT JOIN q1 USING (src)),
ds AS (
  SELECT d.*, f.source_size, f.target, f.seats AS src_seats,
         ('0x' || substr(ord, 1, 8))::BIGINT % shards AS shard
  FROM d JOIN f USING (src)),
sh AS (SELECT src, shard, src_seats, sum(size)::BIGINT AS words FROM ds GROUP BY ALL),
p2 AS (SELECT *, (sum(words) OVER (PARTITION BY src))::DOUBLE AS votes FROM sh),
q2 AS (
  SELECT src, shard, count(*) AS seats FROM (
    SELECT src, shard, src_seats,
           row_number() OVER (PARTITION BY src ORDER BY q DESC, shard) AS rk FROM (
      SELECT src, shard, src_seats,
             words::DOUBLE / (2 * unnest(range(0, (words * src_seats / votes)::BIGINT + 3)) + 1) AS q
      FROM p2 WHERE votes > 0) u) r
  WHERE rk <= src_seats GROUP BY ALL),
b AS (
  SELECT sh.src, sh.shard, ceil(words / 16.0)::BIGINT AS blocks,
         least(coalesce(seats, 0), 2 * ceil(words / 16.0)::BIGINT) AS quota,
         md5('mix-1' || sh.src || '/' || sh.shard) AS mark
  FROM sh LEFT JOIN q2 USING (src, shard)),
b2 AS (
  SELECT *, ([2147483647, 2147483629, 2147483587, 2147483579])[('0x' || substr(mark, 1, 8))::BIGINT % 4 + 1] AS prime,
         ('0x' || substr(mark, 9, 8))::BIGINT AS turn, greatest(blocks, 1) AS safe FROM b),
x AS (
  SELECT ds.*, (sum(size) OVER (PARTITION BY src, shard ORDER BY ord, doc_id, size
                ROWS UNBOUNDED PRECEDING))::BIGINT - size AS st FROM ds)
SELECT doc_id, size, source_size, target,
       (quota // safe * size + CASE WHEN size = 0 THEN 0 ELSE coalesce(list_sum(list_transform(
          range(st // 16, (st + size - 1) // 16 + 1),
          lambda k: CASE WHEN (k * prime + turn) % safe < quota % safe
                         THEN least(st + size, (k + 1) * 16) - greatest(st, k * 16) ELSE 0 END)), 0) END)::BIGINT AS taken
FROM x JOIN b2 USING (src, shard)
"""


@query("op5_source_mix", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes of every document."""
    from triagemill.llm.mixing import mix

    return mix(documents(spark, sf_dir))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learnt from three quarters of the labels."""
    from triagemill.llm.toxicity import fit_toxicity, score_toxicity

    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


PII_KEY_SETTING = "spark.triagemill.pii.key"
PII_KEY = "corpus-pseudonyms-1"


def pii_key(spark: SparkSession) -> str:
    """The secret of the pseudonyms from the session; a public one where none is set, as in tests."""
    return spark.conf.get(PII_KEY_SETTING, PII_KEY)


@query("op9_pii_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of all documents with keyed pseudonyms, and matches by kind."""
    from triagemill.llm.pii import pseudonymize

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonymize(docs, pii_key(spark)).select("doc_id", "text", "pii_counts.*")


@query("op6_nearest_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of every hundredth embedding among all others."""
    from triagemill.llm.neighbours import nearest_neighbours

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(rows, F.col("vec_id") % 100 == 0)


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tb),
dw AS (SELECT DISTINCT unnest(ws) AS x FROM w),
db AS (
  SELECT x, list_transform(range(octet_length(encode(x))),
         lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT) AS bs FROM dw),
dc AS (
  SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, bs),
         lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM db, tab),
pw AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
h AS (SELECT doc_id, list(crc ORDER BY i) AS hs FROM pw JOIN dc USING (x) GROUP BY doc_id),
g AS (
  SELECT doc_id, list_concat(
    list_transform(hs, lambda x: x % 8192),
    list_transform(range(1, len(hs)), lambda i: (hs[i] * 1000003 + hs[i + 1]) % 8192)) AS gs FROM h),
e AS (SELECT doc_id, unnest(gs) AS b FROM g),
q AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
c AS (
  SELECT b, count(*) AS r, count(q.doc_id) AS t FROM e LEFT JOIN q USING (doc_id) GROUP BY b),
z AS (SELECT sum(r) + 8192 AS rs, sum(t) + 8192 AS ts FROM c),
k AS (SELECT b, ln(t + 1) - ln(r + 1) + (SELECT ln(rs) - ln(ts) FROM z) AS v FROM c),
sc AS (SELECT doc_id, avg(v) AS score FROM e JOIN k USING (b) GROUP BY doc_id),
f AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rp AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM f), range(5) AS o(j)
  WHERE n > 1 GROUP BY doc_id),
l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)),
         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(score, 0.0) AS score
  FROM w JOIN l USING (doc_id) LEFT JOIN rp USING (doc_id) LEFT JOIN sc USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND score >= -0.05 AS kept
FROM m
"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and n-gram likelihood verdict of every whole text."""
    from triagemill.llm.quality import quality_rules, ratio_weights

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, ratio_weights(docs, labels.filter("quality = 1")))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT t, min(doc_id) AS rep, count(*) AS n_copies, any_value(ws) AS ws FROM w GROUP BY t),
s AS (
  SELECT DISTINCT rep, unnest(CASE
    WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM x),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rep < b.rep
  GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN z za ON za.rep = a JOIN z zb ON zb.rep = b
  WHERE c / (za.n + zb.n - c) >= 0.8),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, seen) AS (
  SELECT rep, rep FROM x UNION SELECT reach.node, e.b FROM reach JOIN e ON seen = e.a),
c AS (SELECT node, min(seen) AS class_id FROM reach GROUP BY node)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies
FROM w JOIN x USING (t) JOIN c ON rep = node
LEFT JOIN (SELECT a, count(*) AS n_links FROM e GROUP BY a) k ON k.a = rep
"""


@query("op1_ngram_jaccard_join", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document at a similarity of 0.8 or more."""
    from triagemill.llm.jaccard import jaccard_join

    return jaccard_join(documents(spark, sf_dir))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n
  FROM documents),
seg AS (
  SELECT doc_id, base, least(256, n - 49 - base) AS m, substr(h, 2 * base + 1, 610) AS hs
  FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 256)) AS base FROM d WHERE n >= 50)),
p AS (
  SELECT doc_id, base + j AS i, substr(hs, 2 * j + 1, 100) AS s
  FROM (SELECT doc_id, base, hs, unnest(range(0, m)) AS j FROM seg)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s),
r AS (SELECT doc_id, i FROM p JOIN f USING (s) WHERE first < doc_id),
g AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens
        FROM r)),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, k),
gap AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS pb FROM sp),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a)
                 || substr(any_value(h), 2 * max(b) + 1) AS kh,
         sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kh, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op2_suffix_array_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 50-byte strings of earlier documents cover."""
    from triagemill.llm.suffixes import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


CRC_TABLE_SQL = r"""tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tb)"""

OP12_SQL = (
    "WITH "
    + CRC_TABLE_SQL
    + r""",
o AS (
  SELECT conv_id, list(row(coalesce(role, ''), coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, role, text) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (
  SELECT conv_id, ts, list_transform(range(length(conv_id::VARCHAR)),
         lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT) AS bs FROM o),
h AS (
  SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, bs),
         lambda c, x: xor(c >> 8, tb[(xor(c, x) & 255) + 1])), 4294967295) % 9 AS h FROM b, tab),
r AS (
  SELECT h.conv_id, list_concat(coalesce(o.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts
  FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS depth FROM r),
n AS (
  SELECT ts[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ts) = depth), '') AS ends
  FROM p GROUP BY ALL),
c AS (
  SELECT node, depth, conv_id, n_convs, ends, node[1:depth - 1] AS up,
         CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(node[depth][2])) ELSE 0 END AS saved
  FROM n),
k AS (SELECT up, count(*) AS n_children FROM c WHERE depth > 0 GROUP BY up),
f AS (SELECT c.*, coalesce(n_children, 0) AS n_children FROM c LEFT JOIN k ON k.up = c.node),
a AS (
  SELECT node[1:d] AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves,
       a.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN a ON a.top = f.node LEFT JOIN n u ON f.depth > 0 AND u.node = f.up
"""
)


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of all rebuilt conversations."""
    from triagemill.llm.tries import conversation_paths, forked_paths, prefix_trie

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(forked_paths(conversation_paths(rows)))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of all embeddings."""
    from triagemill.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op13_simhash_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at 2 or fewer differing bits."""
    from triagemill.llm.simhash import simhash_groups

    return simhash_groups(documents(spark, sf_dir))
