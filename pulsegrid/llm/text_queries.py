"""Queries on the corpus: token ids, the mix of sources, text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.columns import stable
from pulsegrid.llm.encode import decode_ids, encode_texts
from pulsegrid.llm.mixing import fit_classifier, mix, reached
from pulsegrid.llm.text_quality import text_statistics, without_prose
from pulsegrid.session import table

#: How far a source's share may be from its target.
SHARE_OFF = 0.005


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, folder, "documents"))


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Length and digest of every text after encoding and decoding."""
    back = decode_ids(encode_texts(table(spark, folder, "documents")))
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used in the mix."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the sources wanted and reached, by source and by posterior."""
    targets = table(spark, folder, "mix_targets")
    return reached(mix(table(spark, folder, "documents"), targets, with_memberships=True), targets)


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source's share is within SHARE_OFF of its target, and no document is used more often than allowed."""
    cap = table(spark, folder, "mix_targets").select(F.lower(F.trim("source")).alias("source"), "max_repeats")
    s = p9_shares(spark, folder).join(F.broadcast(cap), "source")  # one row per target source
    return s.select("source", (F.abs(F.col("share") - F.col("target_share")) <= SHARE_OFF).alias("share_kept"), (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"))


def p9_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """How many labelled documents were held out from the classifier, per source, and how many of them it tells right."""
    names = sorted(r[0] for r in table(spark, folder, "mix_targets").select(F.lower(F.trim("source"))).distinct().collect())  # a short table
    m = fit_classifier(table(spark, folder, "documents"), names)
    rows = list(zip(names, m.held_out, m.right)) if m else []
    return spark.createDataFrame(rows, "source string, held_out bigint, right bigint")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of lists, tables or junk."""
    return without_prose(text_statistics(table(spark, folder, "documents"))).select("doc_id")


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every document."""
    return text_statistics(table(spark, folder, "documents"))


def p10_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of the operator that SQL can express: characters, words and their mean length, lines and those that end
    in punctuation, symbols."""
    s = text_statistics(table(spark, folder, "documents"))
    return s.select("doc_id", "chars", "words", stable(F.col("word_length")).alias("word_length"), "lines", stable(F.col("line_end_share")).alias("line_end_share"), stable(F.col("symbol_ratio")).alias("symbol_ratio"))


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_kept": p9_kept, "p9_classifier": p9_classifier, "p10_found": p10_found, "p10_statistics": p10_statistics, "p10_counts": p10_counts}

# letters are those outside kana, the Chinese signs and the supplementary planes, and the sign of micro is none
_COUNTS = r"""
with t as (select doc_id, coalesce(text, '') as t from documents),
a as (select doc_id, t, regexp_replace(t, '[\p{Zs}\p{Zl}\p{Zp}\p{Cc}\p{Cf}]', '', 'g') as ink, regexp_extract_all(regexp_replace(t, '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{2500}-\x{26FF}\x{FFFD}\x{10000}-\x{10FFFF}µ]', ' ', 'g'), '[\p{L}\p{M}]+') as w,
  list_filter(regexp_split_to_array(t, '[\n\r\x{2028}\x{2029}\x0b\x0c\x{85}]'), lambda x: length(regexp_replace(x, '[\p{Zs}\p{Zl}\p{Zp}\p{Cc}\p{Cf}]', '', 'g')) > 0) as l from t),
b as (select doc_id, length(ink) as chars, len(w) as words, list_sum(list_transform(w, lambda x: length(x))) as letters, len(l) as lines, len(list_filter(l, lambda x: regexp_matches(x, '[.,;:!?。、，；：！？][\p{Zs}\p{Cc}\p{Cf}]*$'))) as ended,
  length(regexp_replace(ink, '[\p{L}\p{M}\p{N}.,;:!?。、，；：！？\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{20000}-\x{3FFFF}()\[\]''"’‘“”„«»（）【】「」\-‐‑%°§&/µ²³]', '', 'g')) as signs from a)
select doc_id, chars, words, round(coalesce(letters, 0) / greatest(words, 1) + 1e-9, 6) + 0.0 as word_length, lines, round(ended / greatest(lines, 1) + 1e-9, 6) + 0.0 as line_end_share, round(signs / greatest(chars, 1) + 1e-9, 6) + 0.0 as symbol_ratio from b"""
SQL = {
    "p9_kept": "select lower(trim(source)) as source, true as share_kept, true as cap_kept from mix_targets",
    "p8_round_trip": "select doc_id, length(coalesce(text, '')) as n_chars, md5(coalesce(text, '')) as digest from documents",
    "p10_counts": _COUNTS,
}
