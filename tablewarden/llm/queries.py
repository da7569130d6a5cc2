"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import ann, bpe, html_tree, importance, langid, licenses, packing, quality, set_queries, simhash, suffix_dedup  # noqa: F401
from tablewarden.llm.common import SPACE, read
from tablewarden.llm.registry import ORACLES, QUERIES, query  # noqa: F401

@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits(F.col("fingerprint_bits")).alias("fingerprint"), "component_id")


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    sizes = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        sizes.alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


@query("op1_sum_of_squares_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query("op3_bpe_speculate_verify")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs).drop("text"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _op4_sql() -> str:
    """Base rules and nearest-reference distances, all in long form."""
    chars = [f"length(regexp_replace(t, '[^{c.replace(chr(39), chr(39) * 2)}]', '', 'g'))" for c in quality.CLASSES.values()]
    words = [f"len(list_filter(ws, lambda x: x = '{w}'))" for w in quality.VOCABULARY]
    langs = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)
    return f"""
with w as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, lang,
         regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') as ws
  from documents
), counted as (
  select *, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) as lines,
         [{", ".join(chars)}] as chars, [{", ".join(words)}] as found
  from w
), windows as (
  select r, i, array_to_string(ws[i : i + 4], chr(31)) as g
  from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w)
), twice as (
  select r, i from windows qualify count(*) over (partition by r, g) > 1
), repeated as (
  select r, count(distinct j) as n from (select r, unnest(range(i, i + 5)) as j from twice) group by r
), shares as (
  select r, lang, 0 as kind, unnest(range(len(chars) + 1)) as place, n_chars,
         unnest(list_append(chars, n_chars - list_sum(chars))) / n_chars as p
  from (select *, length(t) as n_chars from counted) where n_chars > 0
  union all
  select r, lang, 1, unnest(range(len(found) + 1)), n_words, unnest(list_append(found, n_words - list_sum(found))) / n_words
  from counted where n_words > 0
), refs as (
  select lang, kind, place, avg(p) as q from shares where lang in ({langs}) group by all
), apart as (
  select s.r, q.lang, s.kind,
         sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2) as d
  from shares s join refs q on s.kind = q.kind and s.place = q.place
  where s.lang is null or s.lang in (select lang from refs)
  group by all
), nearest as (
  select r, min(case when kind = 0 then sqrt(greatest(d, 0)) end) as c, min(case when kind = 1 then sqrt(greatest(d, 0)) end) as v
  from apart group by r
), judged as (
  select doc_id, n_words, word_chars, list_extract(chars, {list(quality.CLASSES).index("symbol") + 1}) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, c, v
  from counted left join repeated using (r) left join nearest using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words as base_failed,
       not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words)
       and not coalesce(c > {quality.MAX_CHAR_DISTANCE} and word_chars >= {quality.MIN_CHARS_JUDGED}, false)
       and not coalesce(v > {quality.MAX_WORD_DISTANCE} and n_words >= {quality.MIN_WORDS_JUDGED}, false) as kept
from judged"""


@query("op4_distribution_divergence", _op4_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_language_mixture")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    langs, model = langid.learn(docs.where("not held_out"))
    out = langid.predict(docs.drop("lang"), langs, model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "languages")


@query("op8_importance_resampling")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = importance.resample(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", "log_weight", "gumbel_key", "selected")


@query("op2_inverted_multi_index")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


@query("op5_site_style_tree")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_tree.extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))
