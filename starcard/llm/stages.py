"""Operators as filters and rewrites of a documents table: columns in, the same columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcard.llm.common import fold_of, free_name
from starcard.llm.language_id import UNKNOWN, fit, with_language
from starcard.llm.line_dedup import MIN_CHARS, dedup_lines
from starcard.llm.mixing import mix_keeping
from starcard.llm.simhash import RADIUS, fingerprint_column, with_roots
from starcard.session import broadcast_if_small, stored


def keep_known_languages(docs: DataFrame, least: float = 0.5, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Documents whose words fit a learnt language by at least ``least``; a missing ``lang`` is filled in.

    Texts that are null, empty or without letters go, foreign languages and noise too, and everything where no row has a
    language to learn from.
    """
    teaching = docs.filter(fold_of(F.col("doc_id"), folds) != held_out)
    model = fit(teaching.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    told = free_name(docs, "_language")
    found = with_language(docs, model, told)
    kept = found.filter((F.col(told)["lang"] != UNKNOWN) & (F.col(told)["fit"] >= least))
    return kept.withColumn("lang", F.coalesce("lang", F.col(told)["lang"])).select(*docs.columns)


def without_repeated_lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Texts without later copies of repeated line runs; documents of which nothing is left go."""
    told = free_name(docs, "_lines")
    done = dedup_lines(docs, least, name=told)
    kept = done.withColumn("text", F.col(told)["kept"]).withColumn("n_chars", F.length("text").cast("long"))
    return kept.filter((F.col(told)["n_removed"] == 0) | (F.trim("text") != "")).select(*docs.columns)


def one_per_near_group(docs: DataFrame, radius: int = RADIUS, words_per_shingle: int = 4) -> DataFrame:
    """One document of each of op2's groups: that of the smallest id, a null id being the last choice, then of the least text hash.

    Rows without an id are documents of their own, and so are rows of one id with different texts. Rows equal in id and text are one
    document, of which one row stays. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("t")).alias("k")
    rows = stored(docs.select(key, fingerprint_column(text, words_per_shingle).alias("fp")), "near-rows")
    named = with_roots(rows.groupBy("fp").agg(F.min("k").alias("k")), radius)
    stays = stored(named.groupBy("root").agg(F.min("k").alias("k")).select("k"), "near-stays")
    own = free_name(docs, "_key")
    kept = docs.withColumn(own, key).join(stays.withColumnRenamed("k", own), own, "left_semi")
    twice = stored(rows.groupBy("k").count().filter("count > 1").select(F.col("k").alias(own)), "near-repeated")
    twice, _ = broadcast_if_small(twice)
    order = F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256)
    one = kept.join(twice, own, "left_semi").groupBy(own).agg(F.min_by(F.struct(*docs.columns), order).alias("r"))
    return kept.join(twice, own, "left_anti").select(*docs.columns).unionByName(one.select(*[F.col("r")[c].alias(c) for c in docs.columns]))


def mixed_keeping_clean(docs: DataFrame, labels: DataFrame, keep: str = "clean", drop: str = "toxic") -> DataFrame:
    """Every document as often as its rate says, rounded by a hash of its id: none of ``drop``, all others, ``keep`` more often."""
    mixed = free_name(docs, "_mix")
    rated, _ = mix_keeping(docs, labels, keep, drop, name=mixed)
    copies = F.col(mixed)["copies"]
    again = free_name(rated, "_copy")
    return rated.filter(copies > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)
