"""The operators' registered queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import (
    maxent,
    mixing,
    packing,
    pivots,
    pseudonyms,
    rabitq,
    repeats,
    simhash,
    spelling,
    toxicity,
    url_rules,
    warc,
    whitening,
)
from basketlens.llm.common import read, scratch

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values of the url query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def byte_bpe() -> tuple[str, str, str]:
    """The public byte-level vocabulary: its file, its ranks and its word pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), byte_bpe())


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(read(spark, sf_dir, "pages"), rules)


def op5_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write_archive(read(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).drop("url")


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(read(spark, sf_dir, "documents"))


# The query's key. A real run takes its own from a secret store.
PSEUDONYM_KEY = "registered query"


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymized(docs, PSEUDONYM_KEY, found="kinds")


def op10_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(read(spark, sf_dir, "embeddings"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeats.without_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256")
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_url_rules": op4_url_rules,
    "op5_rabitq": op5_rabitq,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_maxent": op8_maxent,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_pivots": op10_pivots,
    "op11_repeats": op11_repeats,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}

_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op4_url_rules": f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {_RULE_VALUES}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
uniq AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT u.host, u.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM uniq u JOIN rules r
    ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS id,
         CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest
  FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS weight,
             (3 * source_size)::DOUBLE AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights,
             coalesce(sum(cap) OVER fill, 0) AS spent, coalesce(sum(weight) OVER fill, 0) AS passed
      FROM w WINDOW fill AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - spent) / (weights - passed) AS lvl FROM f),
t AS (SELECT *, max(lvl) FILTER (WHERE cap > weight * lvl) OVER () AS level FROM l),
src AS (SELECT skey, source_size, weight, budget,
               CASE WHEN cap <= weight * lvl THEN cap ELSE weight * level END AS target FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY skey, id, size, digest) AS nth FROM d),
q AS (SELECT n.*, source_size, weight, target, budget,
             sum(size) OVER (PARTITION BY n.skey ORDER BY digest, id, size, nth ROWS UNBOUNDED PRECEDING) AS cum
      FROM n JOIN src ON n.skey = src.skey),
c AS (SELECT *, ((copy - 1) * source_size + cum)::DOUBLE / weight AS finish
      FROM q, (SELECT unnest([1, 2, 3]) AS copy)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, digest, id, size, copy, nth ROWS UNBOUNDED PRECEDING) AS words FROM c)
SELECT any_value(doc_id) AS doc_id, size, any_value(source_size) AS source_size, any_value(target)::DOUBLE AS target,
       (size * count(*) FILTER (WHERE words <= budget))::BIGINT AS taken
FROM r GROUP BY id, skey, size, digest, nth""",
    "op7_warc": """
WITH r AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS newest FROM r)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(encode(html)) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM m""",
    "op10_pivots": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_repeats": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT row, id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(words) - 48)) t(i)),
r AS (SELECT row, i FROM (SELECT *, min(id) OVER (PARTITION BY h) AS least FROM w) WHERE least < id),
gone AS (SELECT row, list(DISTINCT k) AS gone FROM r, unnest(range(i, i + 50)) t(k) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(
         list_filter(words, lambda x, k: NOT list_contains(gone, k)), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (row)""",
    "op13_spelling": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents)
  GROUP BY ALL),
step AS (  -- the table of CRC-32, reflected polynomial 0xEDB88320
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) t(i)),
digests AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex) + 1, 2), lambda i: ('0x' || substr(hex, i, 2))::BIGINT)),
                                 lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hex FROM runs), step),
words AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM digests)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM words, unnest(range(1, length(word) + 1)) t(i)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.less FROM cut a JOIN words w ON a.less = w.word
  UNION SELECT a.less, a.word FROM cut a JOIN words w ON a.less = w.word),
best AS (SELECT p.word, count(*) AS n_near, min(struct_pack(minus := -w.n, near := p.near)) AS b FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.minus >= 10 * w.n THEN b.near END AS form,
         CASE WHEN -b.minus >= 10 * w.n THEN (-b.minus)::BIGINT END AS form_n
  FROM words w LEFT JOIN best ON w.word = best.word),
walk AS (SELECT word, word AS root, form AS next FROM forms
         UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN forms f ON f.word = walk.next)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word AND walk.next IS NULL""",
}
