"""One query per operator, over its whole table, and the SQL it has to agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, decontaminate, embedding_dedup, html_text, jaccard_join, mixing, prefix_trie,
               pseudonyms, quality_knn, secrets, sharding, suffix_tree, toxicity)
from .common import reliable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the whole benchmark, windows of 13 words."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.expand(found).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLES["op10_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bs AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM bs)),
sizes AS (SELECT DISTINCT n FROM bs),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, n, p FROM dw JOIN bw USING (n, gram)),
words AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by five-word shingles at a similarity of 0.75 or more."""
    return jaccard_join.link(table(spark, sf_dir, "documents"), width=5, percent=75)


ORACLES["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, base kinds and entropy spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", secrets.of_kind(F.col("spans"), "assign").alias("n_assign"),
        secrets.of_kind(F.col("spans"), "access").alias("n_access"),
        secrets.of_kind(F.col("spans"), "hex").alias("n_hex"),
        secrets.of_kind(F.col("spans"), "entropy").alias("n_entropy"),
        F.sha2(secrets.joined(F.col("spans"), base_only=True), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"))


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to 98 % of the highest entropy of sources, at most four passes over any."""
    drawn = mixing.mix(table(spark, sf_dir, "documents"), target_entropy=0.98, max_repeats=4.0)
    return drawn.select("doc_id", "source", "n_tokens", "epoch", "block", "place")


@query
def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the chain fitted on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "p_insult", "p_contempt", "p_toxic", (F.col("p_toxic") >= toxicity.THRESHOLD).alias("toxic"))


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal labels at a cosine of 0.98 or more: direct links, components and who stays."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


ORACLES["op4_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b
  FROM u x JOIN u y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a) USING (vec_id)
"""


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the suffix tree learned from the rows that are not held out."""
    return suffix_tree.score(table(spark, sf_dir, "documents"))


#: A key for the supplied tables; a user of the operator passes a secret one.
DEMONSTRATION_KEY = b"key of the supplied tables"


@query
def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced within their formats."""
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pseudonyms.KINDS), "text", F.transform("spans", lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))).alias("spans"))


@query
def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the votes of labelled neighbours that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.learn(docs, table(spark, sf_dir, "labels")))


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards, by a keyed permutation of row numbers in the order of ids."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.assign(rows, ["doc_id", "size", "text_crc32"], shards=16, seed=2024)
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


ORACLES["op13_sharding"] = r"""
WITH RECURSIVE b AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, list_transform(
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS x
  FROM documents),
-- CRC-32, four bits at a time
c AS (
  SELECT doc_id, size, xor(list_reduce(x, lambda c, v: xor(xor(c >> 4, CAST([0, 498536548, 997073096, 651767980,
    1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920,
    2262029012, 2685067896, 3183342108][(xor(c, v) & 15) + 1] AS BIGINT)) >> 4, CAST([0, 498536548, 997073096,
    651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804,
    2607071920, 2262029012, 2685067896, 3183342108][(xor(xor(c >> 4, CAST([0, 498536548, 997073096, 651767980,
    1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920,
    2262029012, 2685067896, 3183342108][(xor(c, v) & 15) + 1] AS BIGINT)), v >> 4) & 15) + 1] AS BIGINT)),
    CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32
  FROM b),
r AS (
  SELECT doc_id, size, text_crc32, CAST(row_number() OVER (
    ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS n FROM c),
t AS (
  SELECT CAST(count(*) AS BIGINT) AS total, CAST(greatest(1, (length(bin(greatest(count(*) - 1, 0))) + 1) // 2) AS INTEGER) AS half
  FROM r),
-- one round of the network a step; after six rounds a number beyond the last row goes round again
walk(n, k, a, b, total, half) AS (
  SELECT n, 0, n >> half, n & ((CAST(1 AS BIGINT) << half) - 1), total, half FROM r, t
  UNION ALL
  SELECT n, k % 6 + 1, b, xor(a, (((xor(m >> 16, m >> 33) & 2147483647) * 2246822507) >> 17)
    & ((CAST(1 AS BIGINT) << half) - 1)), total, half
  FROM (SELECT *, (xor(b, [180183940, 279522799, 378861658, 478200517, 577539376, 676878235][k % 6 + 1]) & 2147483647) * 2654435761 AS m FROM walk
        WHERE NOT (k = 6 AND (a << half) + b < total))),
p AS (SELECT n, (a << half) + b AS v FROM walk WHERE k = 6 AND (a << half) + b < total)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(v % 16 AS INTEGER) AS shard, v // 16 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN p USING (n)
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations that begin as the first of their hundred."""
    rows, convs = prefix_trie.crossed(table(spark, sf_dir, "conversations"))
    nodes, ends = prefix_trie.build(rows, convs)
    digests = prefix_trie.end_digests(ends)
    return nodes.join(digests, ["depth", "n1", "n2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


ORACLES["op12_prefix_trie"] = r"""
WITH c AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 of the decimal, a bit at a time
h AS (
  SELECT c, xor(list_reduce(list_transform(range(1, 8 * length(CAST(c AS VARCHAR)) + 1), lambda i:
      CAST((ascii(substr(CAST(c AS VARCHAR), CAST((i - 1) // 8 + 1 AS BIGINT), 1)) >> CAST((i - 1) % 8 AS INTEGER)) & 1 AS BIGINT)),
    lambda s, b: xor(s >> 1, CAST(3988292384 * (xor(s, b) & 1) AS BIGINT)), CAST(4294967295 AS BIGINT)),
    CAST(4294967295 AS BIGINT)) % 6 AS h
  FROM c),
t AS (
  SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
led AS (SELECT h.c, t.p, t.turn FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.p <= h),
own AS (SELECT t.c, 1000000 + t.p AS p, t.turn FROM t JOIN h USING (c) WHERE t.p > h),
r AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS p, turn FROM (SELECT * FROM led UNION ALL SELECT * FROM own)),
lists AS (SELECT c, list(turn ORDER BY p) AS turns FROM r GROUP BY c),
s AS (SELECT c, coalesce(turns, []) AS turns FROM c LEFT JOIN lists USING (c)),
members AS (SELECT c, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM s)),
groups AS (
  SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, list(c) AS all_members,
    coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends
  FROM members GROUP BY d, prefix),
nodes AS (
  SELECT g.*, p.conv_id AS parent, CASE WHEN g.d > 0 THEN (g.n_convs - 1) * length(g.prefix[g.d].text) ELSE 0 END AS own
  FROM groups g LEFT JOIN groups p ON p.d = g.d - 1 AND p.prefix = g.prefix[1:g.d - 1]),
children AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (
  SELECT n.d, n.conv_id, n.parent, n.n_convs, coalesce(k.n_children, 0) AS n_children, n.own, n.ends, n.all_members
  FROM nodes n LEFT JOIN children k ON k.d = n.d AND k.conv_id = n.conv_id),
below AS (
  SELECT v.d, v.conv_id, count(*) FILTER (w.n_children = 0) AS n_leaves, sum(w.own) AS saved
  FROM (SELECT d, conv_id, unnest(all_members) AS m FROM full_nodes) v
  JOIN full_nodes w ON w.conv_id = v.m AND w.d >= v.d GROUP BY v.d, v.conv_id)
SELECT f.conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN below b ON b.d = f.d AND b.conv_id = f.conv_id
"""


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, after the damage of the contract."""
    conversations = table(spark, sf_dir, "conversations")
    rows = conversation_repair.damaged(conversations)
    found = reliable(conversation_repair.diagnose(rows))
    digests = conversation_repair.fingerprints(conversation_repair.repair(rows, found)).withColumnRenamed("conv", "_conv")
    ids = conversations.select("conv_id").distinct()
    whole = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(
        digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


ORACLES["op11_conversation_repair"] = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
-- CRC-32 of the name, a bit at a time
h AS (
  SELECT *, xor(list_reduce(list_transform(range(1, 8 * length(name) + 1), lambda i:
      CAST((ascii(substr(name, CAST((i - 1) // 8 + 1 AS BIGINT), 1)) >> CAST((i - 1) % 8 AS INTEGER)) & 1 AS BIGINT)),
    lambda s, b: xor(s >> 1, CAST(3988292384 * (xor(s, b) & 1) AS BIGINT)), CAST(4294967295 AS BIGINT)),
    CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(length(role) || ':' || role || text)) AS p FROM d),
f AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before
  FROM o),
l AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN initial NOT IN ('s', 'u', 'a') THEN 'o'
    ELSE initial END AS role_letter FROM f),
c AS (
  SELECT conv_id, string_agg(CASE WHEN fault = 'truncated' THEN upper(role_letter) ELSE role_letter END, '' ORDER BY p) AS sig,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM l GROUP BY conv_id),
-- cheapest way on from the end, for each state of the grammar: nothing yet, after s, after u, after a
best(sig, i, b0, b1, b2, b3) AS (
  SELECT sig, length(sig), {'c': 0, 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''}
  FROM (SELECT DISTINCT sig FROM c)
  UNION ALL
  SELECT sig, i - 1, list_sort([r0, {'c': n2.c + 5, 'a': 'I' || n2.a}])[1], list_sort([r1, {'c': n2.c + 5, 'a': 'I' || n2.a}])[1], n2, n3
  FROM (
    SELECT *, list_sort([r2, {'c': r3.c + 5, 'a': 'I' || r3.a}])[1] AS n2,
      list_sort([r3, {'c': r2.c + 5, 'a': 'I' || r2.a}])[1] AS n3
    FROM (
      SELECT sig, i,
        list_sort([{'c': b0.c + 2, 'a': 'D' || b0.a}, {'c': b2.c + 1 + late, 'a': 'R' || b2.a},
          {'c': b1.c + late + CASE WHEN r = 's' THEN 0 ELSE 1000000 END, 'a': 'K' || b1.a},
          {'c': b2.c + late + CASE WHEN r = 'u' THEN 0 ELSE 1000000 END, 'a': 'K' || b2.a}])[1] AS r0,
        list_sort([{'c': b1.c + 2, 'a': 'D' || b1.a}, {'c': b2.c + 1 + late, 'a': 'R' || b2.a},
          {'c': b2.c + late + CASE WHEN r = 'u' THEN 0 ELSE 1000000 END, 'a': 'K' || b2.a}])[1] AS r1,
        list_sort([{'c': b2.c + 2, 'a': 'D' || b2.a}, {'c': b3.c + 1 + late, 'a': 'R' || b3.a},
          {'c': b3.c + late + CASE WHEN r = 'a' THEN 0 ELSE 1000000 END, 'a': 'K' || b3.a}])[1] AS r2,
        list_sort([{'c': b3.c + 2, 'a': 'D' || b3.a}, {'c': b2.c + 1 + late, 'a': 'R' || b2.a},
          {'c': b2.c + late + CASE WHEN r = 'u' THEN 0 ELSE 1000000 END, 'a': 'K' || b2.a}])[1] AS r3
      FROM (SELECT *, lower(sig[i]) AS r, CASE WHEN sig[i] = 'x' THEN 1000000 WHEN sig[i] = upper(sig[i]) THEN 5 ELSE 0 END AS late
            FROM best WHERE i > 0)))),
a AS (SELECT c.*, b0.c AS cost, b0.a AS audit FROM c JOIN best ON best.sig = c.sig AND i = 0),
e AS (
  SELECT conv_id, nr, audit[nr] AS edit, len(list_filter(string_split(audit[1:nr], ''), lambda x: x <> 'I')) AS p,
    len(list_filter(string_split(audit[1:nr], ''), lambda x: x <> 'D')) AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS nr FROM a)),
j AS (
  SELECT e.*, l.role, l.text, max(CASE WHEN place = 1 AND edit = 'K' AND role_letter = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY e.conv_id) AS shift
  FROM e LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.p = e.p AND edit <> 'I' WHERE edit <> 'D'),
s AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY nr)) AS sha
  FROM j GROUP BY conv_id)
SELECT n.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) n LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM n.conv_id
"""
