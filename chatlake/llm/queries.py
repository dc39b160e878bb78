"""One query for each operator, over its whole table.  Contracts of the columns are in the operators' docstrings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import bpe, codebooks, counts, decontam, langid, lattice, minhash, quality, rules, simhash, tokenfiles, urls, whitening
from chatlake.llm.common import table


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), word_vocabulary())


#: Fixed values of the query: (host and beginning of a path, verdict).
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page (its id is a label's) is good if its quality is 1 and it is not toxic."""
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def document_edits(docs: DataFrame) -> DataFrame:
    """Three edits of each document: at a place that its id gives, up to 80 characters go and up to 80 from elsewhere in its text come."""
    number = lambda name, most: F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seq").cast("string"), F.lit(name))) % most
    size = F.length("text") + 1
    return docs.select("doc_id", "text", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seq")) \
        .select("doc_id", "seq", number("place", size).alias("position"), number("delete", F.lit(81)).alias("n_delete"),
                F.substring("text", 1 + number("from", size).cast("int"), number("size", F.lit(81)).cast("int")).alias("insert"))


def op4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return counts.count_edits(docs, document_edits(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def language_model(docs: DataFrame, bounded: bool = False) -> langid.PPM:
    """Trees from the documents whose fold of five is not 0."""
    return langid.train(docs.filter(fold("doc_id", 5) != 0), bounded=bounded)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_documents(table(spark, sf_dir, "documents"), word_vocabulary(), end_id=2)
    return tokenfiles.read_documents(files, digest=True)


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = fold("doc_id", 7)
    scored = lattice.score_documents(table(spark, sf_dir, "documents"), remainder != 2, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.OrdinalModel:
    labels = table(spark, sf_dir, "labels")
    return quality.train(docs, labels.select("doc_id", quality.label_grade().alias("grade")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade_documents(docs, quality_model(spark, sf_dir, docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", "n_span", "n_item")).alias("best")).select("doc_id", "item_id", "best.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good labelled rows have quality 1: statistics can't tell a toxic text, operator 8 does."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.judge(docs, rules.train(docs, labels.select("doc_id", (F.col("quality") == 1).alias("good"))))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it exceeds a long (from about ten million vectors on); the operator has it as a decimal."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), wanted=4, scale=256)
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_urls": op2_urls,
    "op3_minhash": op3_minhash,
    "op4_counts": op4_counts,
    "op5_language": op5_language,
    "op6_tokenfiles": op6_tokenfiles,
    "op7_lattice": op7_lattice,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_codes": op11_codes,
    "op12_rules": op12_rules,
    "op13_whitening": op13_whitening,
}

_STRENGTH = """coalesce(case when sum(case when n > 0 then prior * (1 - prior) * (n - 1) end) > 0
      and (sum(case when n > 0 then power(good - n * prior, 2) / n end) - sum(case when n > 0 then prior * (1 - prior) end)) > 0
    then greatest(1.0, least(1000.0, sum(case when n > 0 then prior * (1 - prior) * (n - 1) end)
      / (sum(case when n > 0 then power(good - n * prior, 2) / n end) - sum(case when n > 0 then prior * (1 - prior) end)) - 1))
    when sum(case when n > 0 then prior * (1 - prior) * (n - 1) end) > 0 then 1000.0 end, 10.0)"""

#: DuckDB statements for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op2_urls": f"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut
), outcome as (
  select doc_id, cast(case when quality = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end as double) as good from labels where quality is not null
), hosts as (
  select host, n, good, case when regexp_matches(plain, '^[0-9.]+$') then plain else regexp_extract(plain, '([^.]*\\.)?[^.]*$') end as domain,
    regexp_extract(plain, '[^.]*$') as suffix
  from (select host, regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:[0-9]*)?$', '') as plain, cast(count(good) as double) as n, coalesce(sum(good), 0.0) as good
        from split left join outcome on doc_id = page_id group by host)
), domains as (
  select suffix, domain, sum(n) as n, sum(good) as good from hosts group by all
), suffixes as (
  select suffix, n, good, coalesce((select sum(good) / nullif(sum(n), 0) from hosts), 0.5) as prior
  from (select suffix, sum(n) as n, sum(good) as good from hosts group by all)
), s1 as (
  select suffix, (prior * k + good) / (k + n) as mean from suffixes, (select {_STRENGTH} as k from suffixes)
), d0 as (
  select d.*, s1.mean as prior from domains d join s1 using (suffix)
), d1 as (
  select suffix, domain, (prior * k + good) / (k + n) as mean from d0, (select {_STRENGTH} as k from d0)
), h0 as (
  select h.*, d1.mean as prior from hosts h join d1 using (suffix, domain)
), h1 as (
  select host, k, n, (prior * k + good) / (k + n) as mean from h0, (select {_STRENGTH} as k from h0)
), beta as (
  select host, mean * (k + n) as a, (1 - mean) * (k + n) as b from h1
), verdicts as (
  select host, case when a <= 0 then true when b <= 0 then false else
    exp((a + b) * ln(0.5) - ln(a) - lgamma(a) - lgamma(b) + lgamma(a + b))
    * list_sum(list_transform(range(0, 4000), lambda i: exp(lgamma(a + b + i) - lgamma(a + b) + lgamma(a + 1) - lgamma(a + 1 + i) + i * ln(0.5)))) >= 0.95 end as bad
  from beta
), ruled as (
  select page_id, host, path, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from split
)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
  when bad then 'block' else 'allow' end as verdict
from ruled left join verdicts using (host)""",
}
