"""Search over documents of several fields: BM25F on a stored index that can be added to, deleted from and compacted.

**Layout.** An index is a folder of segments and deletions plus numbered manifests that name the valid ones. A segment holds
its documents' ids, counts and blocks of postings, which tell every document's terms as well. Documents are dealt to groups of
``GROUP_DOCS``, alike in schema and length; a block is one term in one group, in a row: bounds first (most occurrences and least
length per field, least and greatest schema), the postings behind them as an array that is read only where it is needed. Blocks lie
in folders by hash of the term, as many as the postings ask for, sorted by term and group.

**Search.** Bounds of a query's terms add up to a bound for a whole group. The best-bounded groups are scored first; their k-th best
score is what any other group has to reach, and only groups whose bound does are read in a second pass. The result is that of
scoring everything. A query's schemas leave out groups before anything is read, and documents after. Postings travel as blocks,
dealt by group, so no (document, query) pair is shuffled before each group has been cut to its best k.

**Upkeep.** Documents that are added under a known id replace the older version. A deletion is a table of ids, valid for the segments
before it, with the counts that go with them, so that scores are those of a fresh build at any time.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from starcard.functions.text import all_tokens, stem_word, stemmed, tokens
from starcard.operators.search import best
from starcard.operators.segments import SEG, range_segments
from starcard.rules import BM25_B, BM25_K1, STOP_WORDS, TOP_K
from starcard.session import broadcast_if_small, fits, scratch_path, shuffle_width, shuffled, stored

#: Documents of a group, postings of a folder and the most folders, groups that are scored first.
GROUP_DOCS, FOLDER_POSTINGS, MOST_FOLDERS, LEAD = 4096, 4_000_000, 4096, 2
#: So many queries may ask for one block in a row.
ASKED_TOGETHER = 20_000
#: Words that a task counts at a time, blocks it hands on at a time.
COUNTED_WORDS, SENT_BLOCKS = 2_000_000, 20_000
#: Before a term that stands for a whole value; no token of a text has it.
WHOLE = "="


@dataclass(frozen=True)
class Field:
    """A searchable field. ``english``: tokens, lower case, no stop words, stemmed. ``keyword``: whole values as they are."""

    name: str
    weight: float = 1.0
    analyzer: str = "english"
    b: float = BM25_B


@dataclass(frozen=True)
class FieldedIndex:
    """A version of an index. ``segments`` and ``deletions`` are (number, name); a deletion holds for smaller numbers."""

    path: str
    fields: tuple[Field, ...]
    segments: tuple[tuple[int, str, int], ...] = ()
    deletions: tuple[tuple[int, str], ...] = ()
    version: int = 0
    failed: int = 0

    def _next(self) -> int:
        return 1 + max([s[0] for s in self.segments] + [d[0] for d in self.deletions], default=0)

    def parts(self, spark: SparkSession, part: str) -> list[tuple[int, DataFrame]]:
        return [(number, spark.read.parquet(f"{self.path}/segments/{name}/{part}")) for number, name, _ in self.segments]

    def dropped(self, spark: SparkSession, part: str) -> list[tuple[int, DataFrame]]:
        return [(number, spark.read.parquet(f"{self.path}/deletions/{name}/{part}")) for number, name in self.deletions]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _words(value: Column, field: Field) -> Column:
    """Words of a field as they stand; a null value has none."""
    if field.analyzer == "keyword":
        return F.transform(F.filter(value, lambda v: v.isNotNull()), lambda v: F.concat(F.lit(WHOLE), v))
    return all_tokens(value)


def query_terms(queries: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Distinct terms of every query; keyword fields are asked for the whole text."""
    kinds = {f.analyzer for f in fields}
    parts = []
    if "english" in kinds:
        parts.append(stemmed(tokens(F.col("text"))))
    if "keyword" in kinds:
        parts.append(F.when(F.col("text").isNotNull(), F.array(F.concat(F.lit(WHOLE), F.col("text")))))
    none = F.array().cast("array<string>")
    terms = F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts]))
    return queries.select("query_id", F.explode(terms).alias("term"))


def _folder(folders: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int")


def _counted(docs: DataFrame, fields: Sequence[Field], schema: str | None, n_docs: int) -> DataFrame:
    """Blocks of documents that a task counted together: see ``_counter``. Of a single group they are parts of blocks.

    Only texts are shuffled, dealt by group, so blocks are put together where the texts are. A group with more words than are
    counted at a time becomes several.
    """
    kind = {f.name: f.dataType for f in docs.schema}
    place = kind[schema] if schema else StringType()
    docs = docs.withColumn("_schema", F.col(schema) if schema else F.lit(None).cast("string"))
    groups = _groups(n_docs)
    if groups > 1:
        size = sum((F.coalesce(F.size(f.name) if f.analyzer == "keyword" else F.length(f.name), F.lit(0)) for f in fields), F.lit(0))
        # groups of long documents are the first tasks
        dealt = docs.withColumn("_size", size).repartitionByRange(groups, "_schema", F.desc("_size"), "doc_id")
        dealt = dealt.withColumn("grp", F.spark_partition_id())
    else:
        dealt = docs.withColumn("grp", F.lit(0)).repartition("doc_id")
    words = dealt.select(
        "doc_id", "grp", F.col("_schema").alias("schema"), *[_words(F.col(f.name), f).alias(f"w{i}") for i, f in enumerate(fields)]
    )
    counts, sums = ArrayType(IntegerType()), ArrayType(LongType())
    posting = [StructField("doc_id", kind["doc_id"]), StructField("schema", place), StructField("tf", counts), StructField("lens", counts)]
    block = [
        StructField("term", StringType()), StructField("grp", IntegerType()), StructField("n", IntegerType()),
        StructField("top", counts), StructField("low", counts), StructField("first_schema", place), StructField("last_schema", place),
        StructField("sums", sums), StructField("postings", ArrayType(StructType(posting))),
    ]
    return words.mapInArrow(_counter([f.analyzer != "keyword" for f in fields], groups if groups > 1 else 0), StructType(block))


def _counter(english: list[bool], step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents (doc_id, grp, schema, words by field) to blocks, of as many documents at a time as have ``COUNTED_WORDS`` words.

    A block is a term in a group: number of postings, most occurrences, least length, least and greatest schema, occurrences in all, postings.
    Documents of a task that are counted later are of a group numbered ``step`` higher.
    """
    m, stop, most, sent = len(english), set(STOP_WORDS), COUNTED_WORDS, SENT_BLOCKS

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, m, dtype=np.int32)), pa.array(values.ravel(), kind))

    def blocks(part: pa.Table, more: int) -> Iterator[pa.RecordBatch]:
        n = part.num_rows
        ids, schemas = part["doc_id"].combine_chunks(), part["schema"].combine_chunks()
        rank, codes = np.empty(n, np.int64), {}
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(n)
        owners, lens = [], np.zeros((n, m), np.int32)
        for i in range(m):
            held = part[f"w{i}"].combine_chunks()
            of = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
            coded = held.flatten().dictionary_encode()
            own = np.empty(len(coded.dictionary), np.int64)
            for j, word in enumerate(coded.dictionary.to_pylist()):
                term = ("" if word in stop else stem_word(word)) if english[i] else word
                own[j] = codes.setdefault(term, len(codes)) if term else -1
            term = own[coded.indices.to_numpy(zero_copy_only=False)]
            of, term = of[term >= 0], term[term >= 0]
            lens[:, i] = np.bincount(of, minlength=n)
            owners.append((of, term))
        if not codes:
            return
        grps, grp = np.unique(part["grp"].to_numpy(), return_inverse=True)
        # one number per posting: group, term, document by id
        key = np.concatenate([(grp[of] * len(codes) + term) * n + rank[of] for of, term in owners])
        posts, at = np.unique(key, return_inverse=True)
        ends = np.cumsum([len(of) for of, _ in owners])[:-1]
        tf = np.stack([np.bincount(x, minlength=len(posts)) for x in np.split(at, ends)], axis=1).astype(np.int32)
        block, doc = posts // n, np.argsort(rank)[posts % n]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        counts = np.diff(starts, append=len(posts))
        coded = schemas.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        of_schema = np.append(np.argsort(order), -1)[pc.fill_null(coded.indices, len(order)).to_numpy(zero_copy_only=False)][doc]
        last = np.maximum.reduceat(of_schema, starts)
        first = np.minimum.reduceat(np.where(of_schema < 0, len(order), of_schema), starts)
        sorted_schemas = coded.dictionary.take(pa.array(order))

        def named(i: np.ndarray) -> pa.Array:
            return sorted_schemas.take(pa.array(i, mask=(i < 0) | (i >= len(order))))

        posting = pa.StructArray.from_arrays(
            [ids.take(pa.array(doc)), schemas.take(pa.array(doc)), lists(tf, pa.int32()), lists(lens[doc], pa.int32())], ["doc_id", "schema", "tf", "lens"]
        )
        found = pa.RecordBatch.from_arrays(
            [
                pa.array(list(codes), pa.string()).take(pa.array(block[starts] % len(codes))),
                pa.array(grps[block[starts] // len(codes)] + more, pa.int32()), pa.array(counts, pa.int32()),
                lists(np.maximum.reduceat(tf, starts), pa.int32()), lists(np.minimum.reduceat(lens[doc], starts), pa.int32()),
                named(first), named(last), lists(np.add.reduceat(tf.astype(np.int64), starts), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.append(starts, len(posts)).astype(np.int32)), posting),
            ],
            ["term", "grp", "n", "top", "low", "first_schema", "last_schema", "sums", "postings"],
        )
        for begin in range(0, found.num_rows, sent):
            yield found.slice(begin, sent)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, more = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += sum(len(batch.column(f"w{i}").flatten()) for i in range(m))
            if size >= most:
                yield from blocks(pa.Table.from_batches(held), more)
                held, size, more = [], 0, more + step
        if held:
            yield from blocks(pa.Table.from_batches(held), more)

    return counted


def _groups(n_docs: int) -> int:
    return max(1, -(-n_docs // GROUP_DOCS))


def _placed(sized: DataFrame, groups: int) -> DataFrame:
    """(doc_id, grp) of documents (doc_id, schema, size): groups of documents alike in schema and size."""
    return range_segments(sized, ["schema", "size", "doc_id"], groups).select("doc_id", F.col(SEG).alias("grp"))


def _per_field(array: str, fields: Sequence[Field], how) -> Column:
    return F.array(*[how(F.get(array, F.lit(i))) for i in range(len(fields))])


def _accepted(docs: DataFrame, fields: Sequence[Field]) -> tuple[DataFrame, int]:
    """Rows that can be indexed, and how many can't: those without an id, and all but one of those that share one."""
    named = docs.filter(F.col("doc_id").isNotNull())
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    odd = stored(counts, "repeated-ids")
    lost = odd.agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(F.col("n") - 1))).first()[0] or 0
    if not lost:
        return named, 0
    twice = odd.filter(F.col("doc_id").isNotNull()).select("doc_id")
    content = F.struct(*[c for c in docs.columns if c != "doc_id"])
    one = named.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(content).alias("c")).select("doc_id", "c.*")
    return named.join(twice, "doc_id", "left_anti").unionByName(one), lost


def _write_segment(spark: SparkSession, parts: DataFrame, path: str, fields: Sequence[Field], n_docs: int, whole: bool = False) -> int:
    """Blocks, term counts and totals from written parts of blocks (``whole``: they are blocks); returns the number of folders."""
    sums = [F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(len(fields))]
    many, *lens = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), *sums).first()
    folders = 1 << max(0, min(MOST_FOLDERS, many // FOLDER_POSTINGS).bit_length())
    # parts go where their block is written, so a block is put together there; those of a frequent term are dealt by group as well
    share = F.pmod(F.col("grp"), F.lit(max(1, shuffle_width(spark) // 4)))
    blocks = parts.drop("sums").withColumn("folder", _folder(folders)).withColumn("share", share).repartition("folder", "share")
    if not whole:
        joined = blocks.groupBy("folder", "share", "term", "grp").agg(
            F.sum("n").cast("int").alias("n"), _per_field("top", fields, F.max).alias("top"), _per_field("low", fields, F.min).alias("low"),
            F.min("first_schema").alias("first_schema"), F.max("last_schema").alias("last_schema"),
            F.collect_list("postings").alias("p"),  # as many as a group has documents
        )
        blocks = joined.withColumn("postings", F.sort_array(F.flatten("p"))).drop("p")
    _write_sorted(blocks.drop("share"), ["folder", "term", "grp"], f"{path}/blocks", many)
    terms = spark.read.parquet(f"{path}/blocks").groupBy("folder", "term").agg(F.sum("n").alias("df"))
    _write_sorted(terms.repartition("folder"), ["folder", "term"], f"{path}/terms", many)
    told = spark.createDataFrame([(n_docs, lens)], "n_docs long, lens array<long>")
    told.coalesce(1).write.parquet(f"{path}/totals")
    return folders


def _write_sorted(rows: DataFrame, order: list[str], path: str, many: int) -> None:
    """Sorted rows in a folder per value of the first column; without any rows a file that tells the columns."""
    if not many:
        rows.limit(0).write.parquet(path)
        return
    rows.sortWithinPartitions(*order).write.partitionBy(order[0]).parquet(path)


def _totals(docs: DataFrame, n_docs: int, m: int) -> DataFrame:
    lens = F.array(*[F.coalesce(F.sum(F.get("lens", F.lit(i)).cast("long")), F.lit(0).cast("long")) for i in range(m)])
    return docs.agg(F.lit(n_docs).cast("long").alias("n_docs"), lens.alias("lens"))


def _publish(spark: SparkSession, index: FieldedIndex) -> FieldedIndex:
    """A manifest is written last: what an interrupted operation leaves behind is in none."""
    index = replace(index, version=index.version + 1)
    text = json.dumps(asdict(index) | {"path": ""})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{index.path}/manifests/{index.version:09d}")
    return index


def open_index(spark: SparkSession, path: str) -> FieldedIndex:
    """The newest version of the index at ``path``."""
    newest = spark.read.format("text").option("recursiveFileLookup", True).load(f"{path}/manifests")
    row = newest.select("value", F.col("_metadata.file_path").alias("at")).agg(F.max_by("value", F.regexp_extract("at", r"/(\d{9})/[^/]*$", 1))).first()
    held = json.loads(row[0])
    return FieldedIndex(
        path, tuple(Field(**f) for f in held["fields"]), tuple(map(tuple, held["segments"])), tuple(map(tuple, held["deletions"])),
        held["version"], held["failed"],
    )


def create_index(spark: SparkSession, path: str, fields: Sequence[Field]) -> FieldedIndex:
    """An empty index; one writer at a time may change it."""
    return _publish(spark, FieldedIndex(path, tuple(fields)))


def is_index(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def add_documents(index: FieldedIndex, docs: DataFrame, schema: str | None = None) -> FieldedIndex:
    """``docs``: doc_id, a column per field, and the schema column a search may be limited by. Known ids are replaced.

    Rows without an id fail; of rows that share one, the one with the least content is taken and the others fail.
    """
    spark = docs.sparkSession
    wanted = docs.select("doc_id", *dict.fromkeys([f.name for f in index.fields] + ([schema] if schema else [])))
    rows, failed = _accepted(wanted, index.fields)
    if index.segments:
        index = delete_documents(index, rows.select("doc_id"), publish=False)
    number = index._next()
    name = f"{number:06d}-{scratch_path(spark, 's').rsplit('-', 1)[1][:8]}"
    path = f"{index.path}/segments/{name}"
    rows.select("doc_id").write.parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids").count()
    folders = _write_segment(spark, stored(_counted(rows, index.fields, schema, ids), "blocks"), path, index.fields, ids, _groups(ids) > 1)
    return _publish(spark, replace(index, segments=(*index.segments, (number, name, folders)), failed=index.failed + failed))


def _dead(index: FieldedIndex, spark: SparkSession) -> DataFrame | None:
    """(doc_id, before): ids of which versions in segments numbered below ``before`` are gone."""
    parts = [ids.select("doc_id", F.lit(number).alias("before")) for number, ids in index.dropped(spark, "ids")]
    return _union(parts).groupBy("doc_id").agg(F.max("before").alias("before")) if parts else None


def _alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, segment, ...) without versions that are gone."""
    if dead is None:
        return rows
    gone, _ = broadcast_if_small(dead)
    r, g = rows.alias("r"), gone.alias("g")
    return r.join(g, (F.col("r.doc_id") == F.col("g.doc_id")) & (F.col("r.segment") < F.col("g.before")), "left_anti")


def _held(index: FieldedIndex, spark: SparkSession, part: str) -> DataFrame:
    return _union([rows.withColumn("segment", F.lit(number)) for number, rows in index.parts(spark, part)])


def _entries(index: FieldedIndex, spark: SparkSession) -> DataFrame:
    """(doc_id, schema, tf, lens, term, segment): the blocks' postings, those of versions that are gone among them."""
    each = _held(index, spark, "blocks").select("term", "segment", F.explode("postings").alias("p"))
    return each.select("p.*", "term", "segment")


def delete_documents(index: FieldedIndex, ids: DataFrame, publish: bool = True) -> FieldedIndex:
    """Delete documents by ``doc_id``; unknown ids do nothing."""
    spark = ids.sparkSession
    if not index.segments:
        return index
    number = index._next()
    name = f"{number:06d}-{scratch_path(spark, 'd').rsplit('-', 1)[1][:8]}"
    path = f"{index.path}/deletions/{name}"
    asked = ids.select("doc_id").distinct()
    dead = _dead(index, spark)
    known = _alive(_held(index, spark, "ids").join(asked, "doc_id", "left_semi"), dead)
    known.select("doc_id").write.parquet(f"{path}/ids")
    gone = spark.read.parquet(f"{path}/ids")
    count = gone.count()
    if not count:
        return index
    rows = stored(_alive(_entries(index, spark).join(gone, "doc_id", "left_semi"), dead), "deleted-entries")
    rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/terms")
    docs = rows.groupBy("doc_id").agg(F.first("lens").alias("lens"))
    _totals(docs, count, len(index.fields)).coalesce(1).write.parquet(f"{path}/totals")
    index = replace(index, deletions=(*index.deletions, (number, name)))
    return _publish(spark, index) if publish else index


def compact(index: FieldedIndex, spark: SparkSession) -> FieldedIndex:
    """One segment with the living documents, from what was analysed before; older versions stay readable until they are removed."""
    if not index.segments:
        return index
    number, dead = index._next(), _dead(index, spark)
    name = f"{number:06d}-{scratch_path(spark, 's').rsplit('-', 1)[1][:8]}"
    path = f"{index.path}/segments/{name}"
    _alive(_held(index, spark, "ids"), dead).select("doc_id").write.parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids").count()
    entries = _alive(_entries(index, spark), dead)
    sized = entries.select("doc_id", "schema", "lens").distinct().select(
        "doc_id", "schema", F.aggregate("lens", F.lit(0), lambda a, x: a + x).alias("size")
    )
    tf = F.transform("tf", lambda x: x.cast("long"))
    parts = entries.join(_placed(sized, _groups(ids)), "doc_id").select(
        "term", "grp", F.lit(1).alias("n"), F.col("tf").alias("top"), F.col("lens").alias("low"), F.col("schema").alias("first_schema"),
        F.col("schema").alias("last_schema"), tf.alias("sums"), F.array(F.struct("doc_id", "schema", "tf", "lens")).alias("postings"),
    )
    folders = _write_segment(spark, stored(parts, "blocks"), path, index.fields, ids)
    return _publish(spark, replace(index, segments=((number, name, folders),), deletions=()))


def totals(index: FieldedIndex, spark: SparkSession) -> tuple[int, list[int]]:
    """Living documents, and their tokens per field."""
    n, lens = 0, [0] * len(index.fields)
    for sign, parts in ((1, index.parts(spark, "totals")), (-1, index.dropped(spark, "totals"))):
        for _, part in parts:
            row = part.first()
            n, lens = n + sign * row["n_docs"], [a + sign * b for a, b in zip(lens, row["lens"], strict=True)]
    return n, lens


def postings(index: FieldedIndex, spark: SparkSession) -> DataFrame:
    """doc_id, term, tf and lens by field, of the living documents."""
    return _alive(_entries(index, spark), _dead(index, spark)).select("doc_id", "schema", "term", "tf", "lens")


def document_counts(index: FieldedIndex, spark: SparkSession) -> DataFrame:
    """term, df over the living documents."""
    parts = [t.select("term", "df") for _, t in index.parts(spark, "terms")]
    parts += [t.select("term", (-F.col("df")).alias("df")) for _, t in index.dropped(spark, "terms")]
    return _union(parts).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def _saturated(tf, low, index: FieldedIndex, means: list[float], k1: float) -> Column:
    """A term's weight from occurrences ``tf`` and lengths ``low``, both functions of the field's number."""
    x = F.lit(0.0)
    for i, f in enumerate(index.fields):
        x = x + F.lit(f.weight) * tf(i) / (1 - f.b + f.b * low(i) / F.lit(means[i]))
    return x * (k1 + 1) / (x + k1)


def _distinct_terms(weights: DataFrame) -> DataFrame:
    return broadcast_if_small(weights.select("term").distinct())[0]


def _reached(asking: DataFrame, bounds: DataFrame) -> DataFrame:
    """(query_id, schemas, schema, segment, grp): groups whose span of schemas holds the one named, for each that a query names.

    The spans, one per group of documents, travel to the schemas, each of which is looked up once in their order.
    """
    ends = bounds.groupBy("segment", "grp").agg(F.min("first_schema").alias("a"), F.max("last_schema").alias("b")).filter("a IS NOT NULL")
    spans = sorted((r["a"], r["b"], r["segment"], r["grp"]) for r in ends.collect())  # a row per 4,096 documents or so
    starts = [s[0] for s in spans]
    furthest = list(accumulate((s[1] for s in spans), max))  # none before ends later
    each = asking.select("query_id", "schemas", F.explode(F.array_distinct("schemas")).alias("schema")).filter(F.col("schema").isNotNull())
    kind = each.schema["schema"].dataType

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for schema in batch.column("schema").to_pylist():
                i = bisect_right(starts, schema) - 1
                while i >= 0 and furthest[i] >= schema:
                    if spans[i][1] >= schema:
                        rows.append((schema, spans[i][2], spans[i][3]))
                    i -= 1
            found = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], batch.schema.field("schema").type), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32())],
                ["schema", "segment", "grp"],
            )

    form = StructType([StructField("schema", kind), StructField("segment", IntegerType()), StructField("grp", IntegerType())])
    places = each.select("schema").distinct().mapInArrow(look_up, form)
    return each.join(shuffled(places), "schema").select("query_id", "schemas", "schema", "segment", "grp")


@dataclass
class Reading:
    """What a search read: candidate blocks, and how many of them it opened."""

    candidates: int = 0
    opened: int = 0


def search(
    index: FieldedIndex, queries: DataFrame, k: int = TOP_K, k1: float = BM25_K1, lead: int = LEAD, reading: Reading | None = None,
) -> DataFrame:
    """query_id, doc_id, score, rank of the k best documents per query, ties to the smaller id.

    ``queries``: query_id, text, and perhaps ``schemas`` (array; null: all). Scores are rounded to 6 places before ranking.
    """
    spark = queries.sparkSession
    if "schemas" not in queries.columns:
        queries = queries.withColumn("schemas", F.lit(None).cast("array<string>"))
    asked = stored(query_terms(queries, index.fields), "query-terms")
    if not index.segments:
        return asked.select("query_id", F.lit(None).cast("string").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    n, lens = totals(index, spark)
    means = [max(x / n, 1e-9) if n else 1.0 for x in lens]
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    counts = document_counts(index, spark).join(asked.select("term").distinct(), "term", "left_semi")
    places = queries.select("query_id", "schemas")
    weights = stored(asked.join(counts, "term").select("query_id", "term", idf.alias("idf")).join(places, "query_id"), "query-weights")
    hint, _ = broadcast_if_small(weights)
    few = F.col("schemas").isNull()
    limited, free = not weights.filter(~few).isEmpty(), not weights.filter(few).isEmpty()
    spans = []
    for number, name, folders in index.segments:
        used = [r[0] for r in weights.select(_folder(folders)).distinct().collect()]  # at most the folders there are
        blocks = spark.read.parquet(f"{index.path}/segments/{name}/blocks").filter(F.col("folder").isin(used))
        spans.append((number, blocks))
    # bounds: the postings' column isn't read here
    bound = F.col("idf") * _saturated(lambda i: F.get("top", F.lit(i)), lambda i: F.get("low", F.lit(i)), index, means, k1)
    within = F.col("schemas").isNull() | F.exists("schemas", lambda s: (s >= F.col("first_schema")) & (s <= F.col("last_schema")))
    bounds = _union([
        blocks.select("term", "grp", "n", "top", "low", "first_schema", "last_schema", F.lit(number).alias("segment")) for number, blocks in spans
    ])
    heads, reached = [], None
    if free or not limited:
        heads.append(bounds.join(hint.filter(few) if limited else hint, "term"))
    if limited:
        # a query meets the groups that reach into its schemas, not every group that has its terms
        asking = weights.filter(~few).select("query_id", "schemas").distinct()
        reached = stored(_reached(asking, bounds), "reached-groups")
        pairs = weights.filter(~few).join(shuffled(reached.drop("schema").distinct()), ["query_id", "schemas"])
        heads.append(pairs.join(shuffled(bounds.join(_distinct_terms(weights), "term", "left_semi")), ["segment", "grp", "term"]))
    heads = _union([rows.filter(within).select("query_id", "segment", "grp", bound.alias("bound")) for rows in heads])
    wanted = stored(
        heads.groupBy("query_id", "segment", "grp").agg((F.sum("bound") + 1e-6).alias("bound"), F.count(F.lit(1)).alias("blocks")), "bounds"
    )
    dead = _dead(index, spark)
    dead = stored(dead, "dead-documents") if dead is not None else None

    def scored(chosen: DataFrame) -> DataFrame:
        """The k best of every query in the chosen groups. A block is dealt once with those who ask for it, not once for each of them.

        Those of a block who name schemas are kept by schema, so a posting meets them alone.
        """
        keys = ["segment", "grp", "term"]
        rows, both = chosen.select("query_id", "segment", "grp"), []
        if free or not limited:
            anywhere = F.lit(None).cast(queries.schema["schemas"].dataType.elementType).alias("schema")
            both.append(rows.join(hint.filter(few) if limited else hint, "query_id").select("query_id", *keys, anywhere, "idf"))
        if limited:
            places = rows.join(shuffled(reached), ["query_id", "segment", "grp"])
            both.append(places.join(shuffled(weights.filter(~few)), ["query_id", "schemas"]).select("query_id", *keys, "schema", "idf"))
        pairs = stored(_union(both), "asked-pairs")
        # bounds how many ask in one row; only a block that more of them want travels more than once
        many, _ = broadcast_if_small(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("asks")).filter(F.col("asks") > ASKED_TOGETHER))
        pack = F.pmod(F.xxhash64("query_id"), F.coalesce(F.floor(F.col("asks") / ASKED_TOGETHER) + 1, F.lit(1))).alias("pack")
        each = pairs.join(many, keys, "left").groupBy(*keys, pack, "schema").agg(F.collect_list(F.struct("query_id", "idf")).alias("who"))
        asks = each.groupBy(*keys, "pack").agg(
            F.first(F.when(F.col("schema").isNull(), F.col("who")), ignorenulls=True).alias("everywhere"),
            F.map_from_entries(F.collect_list(F.when(F.col("schema").isNotNull(), F.struct("schema", "who")))).alias("inside"),
        )
        small, parts = fits(pairs), []
        for number, blocks in spans:
            mine = asks.filter(F.col("segment") == number).select("grp", "term", "everywhere", "inside")
            held = blocks.select("term", "grp", "postings")
            if not small:
                held = held.join(_distinct_terms(weights), "term", "left_semi")
            opened = held.join(F.broadcast(mine) if small else shuffled(mine), ["term", "grp"])
            parts.append(opened.select("grp", "everywhere", "inside", "postings", F.lit(number).alias("segment")))
        asked_for = _union(parts).repartition("segment", "grp")
        if limited:
            none = F.array().cast(pairs.select(F.array(F.struct("query_id", "idf"))).schema[0].dataType)
            opened = asked_for.select("segment", "grp", "everywhere", "inside", F.explode("postings").alias("p"))
            who = F.concat(F.coalesce("everywhere", none), F.coalesce(F.try_element_at("inside", F.col("p.schema")), none))
            each = opened.select("segment", "grp", "p", F.explode(who).alias("q")).select("q.*", "segment", "grp", "p")
        else:
            opened = asked_for.select("segment", "grp", "postings", F.explode("everywhere").alias("q"))
            each = opened.select("q.*", "segment", "grp", F.explode("postings").alias("p"))
        tf, low = (lambda i: F.get("p.tf", F.lit(i))), (lambda i: F.get("p.lens", F.lit(i)))
        part = F.col("idf") * _saturated(tf, low, index, means, k1)
        summed = each.groupBy("segment", "grp", "query_id", F.col("p.doc_id").alias("doc_id")).agg(
            F.round(F.sum(part), 6).alias("score")
        )
        return best(_alive(summed, dead), k).select("query_id", "doc_id", "score", "rank")

    order = best(wanted.select("query_id", F.struct("segment", "grp").alias("doc_id"), F.col("bound").alias("score")), lead)
    first = stored(order.select("query_id", "doc_id.*"), "first-groups")
    found = stored(scored(first), "first-hits")
    least = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("hits"))
    rest = wanted.join(first, ["query_id", "segment", "grp"], "left_anti").join(least, "query_id", "left")
    second = stored(rest.filter((F.coalesce("hits", F.lit(0)) < k) | (F.col("bound") >= F.col("least"))).select("query_id", "segment", "grp"), "second-groups")
    if reading is not None:
        reading.candidates = wanted.agg(F.sum("blocks")).first()[0] or 0
        opened = first.unionByName(second)
        reading.opened = wanted.join(opened, ["query_id", "segment", "grp"]).agg(F.sum("blocks")).first()[0] or 0
    if second.isEmpty():
        return found
    return best(found.drop("rank").unionByName(scored(second).drop("rank")), k).select("query_id", "doc_id", "score", "rank")


def statistics(index: FieldedIndex, spark: SparkSession, sample: int = 0) -> DataFrame:
    """One row: living documents, failed uploads, deleted versions, postings, terms, tokens per field, segments.

    ``sample``: so many best documents for the term of most documents are named besides.
    """
    n, lens = totals(index, spark)
    gone = sum(ids.count() for _, ids in index.dropped(spark, "ids"))
    posts, distinct, word, hits = 0, 0, None, []
    if index.segments:
        counts = stored(document_counts(index, spark), "document-counts")
        row = counts.agg(F.count(F.lit(1)).alias("t"), F.coalesce(F.sum("df"), F.lit(0)).alias("p"), F.min(F.struct(-F.col("df"), "term")).alias("top")).first()
        posts, distinct, word = row["p"], row["t"], row["top"]["term"] if row["top"] else None
        if sample and word:
            asked = spark.createDataFrame([(0, word.removeprefix(WHOLE))], "query_id long, text string")
            hits = [r[0] for r in search(index, asked, sample).orderBy("rank").select(F.col("doc_id").cast("string")).collect()]
    row = (n, index.failed, gone, posts, distinct, lens, len(index.segments), word, ",".join(hits))
    kind = (
        "n_docs long, failed long, deleted long, n_postings long, n_terms long, n_tokens array<long>, n_segments int, "
        "sample_word string, sample_hits string"
    )
    return spark.createDataFrame([row], kind)
