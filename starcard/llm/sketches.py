"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending list of a text's k smallest distinct shingle hashes. Sketches of parts merge
by keeping the k smallest of their union, and two sketches tell resemblance, containment and the number
of distinct shingles. With k = 128 an estimated resemblance has a standard error below 0.045.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcard.llm.common import JAVA_SPACE, id_and_text, lower_ascii
from starcard.session import shuffle_width

K, SHINGLE = 128, 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), JAVA_SPACE), lambda w: w != "")


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Bottom-k sketch (array<long>); a text of fewer words is one shingle, one without words has none."""
    words = words_of(text)

    def of(w: Column) -> Column:
        spans = F.transform(F.sequence(F.lit(1), F.size(w) - (shingle - 1)), lambda i: F.xxhash64(F.slice(w, i, shingle)))
        hashes = (
            F.when(F.size(w) == 0, F.array().cast("array<long>"))
            .when(F.size(w) < shingle, F.array(F.xxhash64(w))).otherwise(spans)
        )
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    # a one-element transform names the words, so they are split once
    return F.transform(F.array(words), of)[0]


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch that both sides hold; two texts without words are alike."""
    return F.transform(
        F.array(merged(a, b, k)),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)
        ),
    )[0]


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k shingles; from there (k - 1) over the share of the hash range that the sketch spans."""
    spanned = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spanned)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; 1 where a has none."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merge_parts(parts: DataFrame, key: str, col: str = "sketch", k: int = K, shares: int = 64) -> DataFrame:
    """One sketch per ``key`` over rows that hold sketches of its parts.

    Parts are merged per (key, share of the hashes) first, so a key with very many parts is spread: each share
    keeps its own k smallest, and the key keeps the k smallest of those.
    """
    hashes = parts.select(key, F.explode(col).alias("h")).distinct()
    by_share = Window.partitionBy(key, F.pmod("h", F.lit(shares))).orderBy("h")
    kept = hashes.withColumn("r", F.row_number().over(by_share)).filter(F.col("r") <= k)
    return kept.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(col))


def text_of(sketch_col: Column) -> Column:
    """The sketch as one string, 16 lowercase hex digits a hash."""
    return F.lower(F.array_join(F.transform(sketch_col, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text) in order of descending doc_id, each with ``next_text``; the last one's next is the first.

    Rows are dealt by ranges of doc_id cut at its percentiles; the first row of the range below is added at the end
    of a range, so one shuffle of the texts serves. Null ids come last; equal ids are ordered by text, descending.
    """
    width = parts or 4 * shuffle_width(docs.sparkSession)
    shares = F.array(*[F.lit(i / width) for i in range(1, width)])
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, F.lit(100 * width)).alias("c")).first()["c"] or []))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    ranged = docs.withColumn("seg", F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))))
    firsts = {r["seg"]: r["id"] for r in ranged.groupBy("seg").agg(F.max("doc_id").alias("id")).collect()}
    segs = sorted(firsts)
    below = {seg: (segs[i - 1] if i else segs[-1]) for i, seg in enumerate(segs)}
    wanted = [i for i in firsts.values() if i is not None]
    heads = ranged.filter(F.col("doc_id").isin(wanted) | F.col("doc_id").isNull())
    heads = heads.groupBy("seg").agg(F.max(F.struct("doc_id", "text")).alias("d"))
    ends = F.create_map(*[F.lit(x) for seg, low in below.items() for x in (low, seg)]) if segs else F.lit(None)
    if segs:
        heads = heads.select(ends[F.col("seg")].alias("seg"), F.lit(1).alias("border"), "d.doc_id", "d.text")
        ranged = ranged.select("seg", F.lit(0).alias("border"), "doc_id", "text").unionByName(heads)
    else:
        ranged = ranged.select("seg", F.lit(0).alias("border"), "doc_id", "text")
    along = Window.partitionBy("seg").orderBy("border", F.desc_nulls_last("doc_id"), F.desc("text"))
    return ranged.withColumn("next_text", F.lead("text").over(along)).filter("border = 0").select(
        "doc_id", "text", "next_text"
    )


def fingerprint_edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Every document's sketch beside that of its edited text (its last half replaced by the next document's first).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and distinct_shingles
    and edited_containment (of the edited text in the document) as estimates. Null texts are empty; texts without words
    have an empty fingerprint and are alike among themselves. Repeated rows each have a row, in the order that
    ``with_next`` gives them. One document alone is its own next. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = with_next(rows).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    )
    made = edited.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k, shingle).alias("a"), sketch(F.col("edited"), k, shingle).alias("e"),
        sketch(F.col("next_text"), k, shingle).alias("b"),
    )
    return made.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("a")).alias("fingerprint"),
        text_of(F.col("e")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_next"),
        distinct_shingles(F.col("a"), k).alias("distinct_shingles"),
        containment(F.col("e"), F.col("a"), k).alias("edited_containment"),
    )
