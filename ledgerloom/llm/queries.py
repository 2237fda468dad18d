"""The registered query of each operator here, and the SQL it is held against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import ann, langid, mixing, packing, quality, simhash, token_counts, token_files, url_filter, warc
from ledgerloom.llm.shared import scratch


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(_table(spark, sf_dir, "pages"), scratch(spark, "archives"), min_bytes=0)
    found = warc.read_archives(spark, files)
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bad_lines", "lost_chars", "kept")])


HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: Urls that rarely lead to prose: link farms, listings, logins, scripts, feeds, calendars, printouts, shops.
URL_PATTERNS = {
    "link_farm": r"[.-]farm[.]example[.]",
    "listing_page": r"[?&]page=[0-9]+&ref=",
    "login": r"/(login|signin|register)[/.?]",
    "script": r"/cgi-bin/",
    "admin": r"/wp-admin/",
    "feed": r"/feed/",
    "session": r"[?&;]sessionid=",
    "reply": r"[?&]replytocom=",
    "calendar": r"/calendar/[0-9][0-9][0-9][0-9]",
    "printout": r"/print/",
    "casino": r"[/.-]casino[/.-]",
    "adult": r"[/.-](porn|xxx|adult)[/.-]",
    "cart": r"/cart/",
}


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), HOST_RULES, URL_PATTERNS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"), block_rows=64, alpha=0.7, period=1000)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), scratch(spark, "token-files"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, files)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", packing.ids_crc32(F.col("ids"), packing.id_width(tokenizer_path("byte_bpe_50k.json"))).alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_ann, op2_warc, op3_language_id, op4_token_counts, op5_quality_rules, op6_url_filter, op7_mixing, op8_simhash, op9_token_files, op10_packing)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op5_sql() -> str:
    q = quality
    space, word = _sql_text(q.SPACE), _sql_text(q.WORD)
    words = lambda x: f"list_filter(regexp_split_to_array({x}, {space}), lambda w: w <> '')"
    chars = lambda x: f"length(regexp_replace({x}, {space}, '', 'g'))"
    only = lambda x, p: f"length(regexp_replace({x}, {_sql_text(p)}, '', 'g'))"
    fails = (
        f"regexp_matches(l, {word}) AND ({only('l', q.NOT_SYMBOL)} * 100 > {chars('l')} * {q.SYMBOL_PERCENT} OR NOT regexp_matches(l, {_sql_text(q.SENTENCE_END)})"
        f" OR ({only('l', q.NOT_SEPARATOR)} >= {q.SEPARATORS} AND {only('l', q.NOT_SEPARATOR)} * 6 > len({words('l')}))"
        f" OR (len({words('l')}) <= {q.BOILERPLATE_WORDS} AND ({' OR '.join(f'contains(lower(l), {_sql_text(p)})' for p in q.BOILERPLATE)})))"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, {words('t')} AS w, string_split(t, chr(10)) AS ls FROM d),
u AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM s),
g AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
p AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + x AS i FROM k, (VALUES (0), (1), (2)) AS v(x) WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, {chars('t')}::BIGINT AS word_chars, {only('t', q.NOT_SYMBOL)}::BIGINT AS n_symbols,
    (len(list_filter(ls, lambda l: regexp_matches(l, {word}))) - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, {word})))))::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, list_filter(ls, lambda l: {fails}) AS bad
  FROM s LEFT JOIN p USING (r)),
x AS (
  SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, len(bad)::BIGINT AS n_bad_lines,
    coalesce(list_sum(list_transform(bad, lambda l: {chars('l')})), 0)::BIGINT AS lost_chars
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_bad_lines, lost_chars,
  NOT base_failed AND 100 * lost_chars <= {q.MAX_LOST_PERCENT} * word_chars AS kept
FROM x"""


def _op6_sql() -> str:
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    fitting = []
    for rule, verdict in sorted(HOST_RULES, key=lambda r: -len(r[0])):
        host, slash, path = rule.partition("/")
        fitting.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')", rule, verdict))
    names = " ".join(f"WHEN regexp_matches(low, {_sql_text(p)}) THEN '{n}'" for n, p in sorted(URL_PATTERNS.items()))
    return f"""
WITH a AS (SELECT page_id, url, {lower('url')} AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, low, {lower('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
e AS (SELECT *, CASE {" ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fitting)} END AS rule, CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fitting)} END AS ruled,
  CASE {names} END AS pattern FROM c)
SELECT page_id, host, path, rule, pattern, coalesce(ruled, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM e"""


_OP1_SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) AS score
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

#: Base32 of a SHA-1: each 5 hexadecimal digits are 20 bits, so 4 letters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {s}) & 31)::INTEGER, 1)" for g in range(8) for s in (15, 10, 5, 0)
)

_OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
k AS (SELECT page_id, t, sha1(t) AS h, strlen(t)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY t) AS least, count(*) OVER (PARTITION BY t) AS n FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN n = 1 OR page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n = 1 OR page_id IS NOT DISTINCT FROM least THEN NULL ELSE least END AS refers_to
FROM k"""

ORACLE_SQL: dict[str, str] = {"op1_ann": _OP1_SQL, "op2_warc": _OP2_SQL, "op5_quality_rules": _op5_sql(), "op6_url_filter": _op6_sql()}
