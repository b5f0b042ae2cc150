"""The corpus operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskgrid.llm import align, chat, common, decontaminate, language_id, lexical, licenses, nearest, ngram_lm, packing, simhash, token_store, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))
    return common.stored(found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"), "op1")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 4-word shingles, 64 bits, radius 4."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in the store, read back from it."""
    path = common.new_path(spark, "tokens")
    token_store.write_token_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return common.stored(common.ids_crc32(token_store.read_token_store(spark, path)), "op7", 1000)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit_on(docs))
    return common.stored(found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"), "op8")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token piece of all documents and its place in a sequence of 4096."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.place(common.stored(common.ids_crc32(cut), "op9", 1000), *packing.make_plan(cut, 4096))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, whole or edited, with the passage found."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, written in windows and read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = chat.write_windows(convs, common.new_path(spark, "chat"), public_tokenizers.path("byte_bpe_50k.json"))
    return common.stored(chat.digests(spark, path), "op10", 500)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document states."""
    found = licenses.licenses(table(spark, sf_dir, "documents"))
    return common.stored(found.select("doc_id", "licenses", F.size("matches").cast("long").alias("n_matches")), "op5")


def _md5_number(name: Column, first: int) -> Column:
    return F.conv(F.substring(F.md5(name), first, 5), 16, 10).cast("long")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against dated lists, as of the page's fetch time.

    The lists follow from the pages' own hosts: a third of all hosts, by hash, went on `spam` on a day of 2024 and half
    of these came off it 60 days later; hosts named adult-* have been on `adult` since March; .org came on `trial` for May.
    Pages were fetched on days of 2024 that follow from page_id.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    captures = pages.withColumn("fetched", day(F.pmod(F.col("page_id") * 7919, F.lit(366))))
    hosts = pages.select(url_filter.host(F.col("url")).alias("domain")).where("domain is not null").distinct()
    spam = hosts.where(_md5_number(F.col("domain"), 1) % 3 == 0).withColumn("d", _md5_number(F.col("domain"), 6) % 300)
    entries = (
        spam.select(F.lit("spam").alias("list"), "domain", F.lit("add").alias("action"), day(F.col("d")).alias("ts"))
        .union(spam.where(_md5_number(F.col("domain"), 11) % 2 == 0).select(F.lit("spam"), "domain", F.lit("remove"), day(F.col("d") + 60)))
        .union(hosts.where("domain like 'adult-%'").select(F.lit("adult"), "domain", F.lit("add"), day(F.lit(60))))
        .union(spark.createDataFrame([("trial", "example.org", "add", 121), ("trial", "example.org", "remove", 152)], "list string, domain string, action string, d long").select("list", "domain", "action", day(F.col("d"))))
    )
    found = url_filter.evaluate(captures, entries)
    return found.select("page_id", "host", F.concat_ws(",", "lists").alias("lists"), F.col("blocked").cast("int").alias("blocked"))


def lm_trains(doc_id: Column) -> Column:
    """Rows that the language model learns from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) != 2


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under a bigram model of six sevenths of them."""
    return ngram_lm.score(table(spark, sf_dir, "documents"), lm_trains(F.col("doc_id")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two public tokenizers' tokens meet in every document, and how its links fare in the whole corpus."""
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that rank highest for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
    TIMESTAMP '2024-01-01' + to_days(CAST((page_id * 7919) % 366 AS INTEGER)) AS fetched
  FROM pages),
h AS (SELECT DISTINCT host AS domain, md5(host) AS m FROM p WHERE host IS NOT NULL),
s AS (SELECT domain, CAST(CAST('0x' || substr(m, 6, 5) AS BIGINT) % 300 AS INTEGER) AS d, CAST('0x' || substr(m, 11, 5) AS BIGINT) % 2 = 0 AS off
  FROM h WHERE CAST('0x' || substr(m, 1, 5) AS BIGINT) % 3 = 0),
e AS (
  SELECT 'spam' AS list, domain, 'add' AS action, TIMESTAMP '2024-01-01' + to_days(d) AS ts FROM s
  UNION ALL SELECT 'spam', domain, 'remove', TIMESTAMP '2024-01-01' + to_days(d + 60) FROM s WHERE off
  UNION ALL SELECT 'adult', domain, 'add', TIMESTAMP '2024-01-01' + to_days(60) FROM h WHERE domain LIKE 'adult-%'
  UNION ALL SELECT 'trial', 'example.org', 'add', TIMESTAMP '2024-01-01' + to_days(121)
  UNION ALL SELECT 'trial', 'example.org', 'remove', TIMESTAMP '2024-01-01' + to_days(152)),
latest AS (
  SELECT p.page_id, e.list, max_by(e.action, e.ts) AS action
  FROM p JOIN e ON (p.host = e.domain OR p.host LIKE '%.' || e.domain) AND e.ts <= p.fetched
  GROUP BY p.page_id, e.list, e.domain),
b AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM latest WHERE action = 'add' GROUP BY page_id)
SELECT p.page_id, p.host, coalesce(b.lists, '') AS lists, CAST(b.lists IS NOT NULL AS INTEGER) AS blocked
FROM p LEFT JOIN b ON p.page_id = b.page_id
"""


OP13_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
d AS (SELECT r, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
k AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM d),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY 1, 2),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) x WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1) x, k),
s AS (
  SELECT item_id, doc_id, p.r, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // length)))) AS BIGINT) AS score
  FROM asked JOIN p USING (term) JOIN w USING (term) JOIN d ON d.r = p.r, k GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) x WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op13_lexical": OP13_SQL}
