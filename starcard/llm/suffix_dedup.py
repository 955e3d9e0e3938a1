"""Repeated byte strings across documents, found with run-length indexes.

A string of ``depth`` bytes has one minimizer: its k-mer with the smallest hash. Equal strings have equal
minimizers, so they meet where minimizers are dealt out by hash, and windows of one minimizer form one
context, its bytes around that k-mer. Three rounds, none of which moves all pairs or one document's work
into one place:

1. Batches of documents send the hashes of their minimizers; each range of hashes answers which occur in
   more than one document.
2. Batches send the contexts of those, each distinct one once with its smallest doc_id. Each range builds a
   run-length index over its contexts and streams them through it (``run_index``).
3. Batches apply the answers: a byte goes when a string over it also starts in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcard.llm.common import hash_ranges, id_and_text, pack, release, unpack
from starcard.llm.run_index import RunIndex
from starcard.session import stored

DEPTH, KMER = 50, 16
#: Odd multipliers of the k-mer hash.
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
LAST = (1 << 63) - 1
#: Bytes that are looked at together; bounds the working memory and keeps it in cache.
STRETCH = 1 << 18
SENT = "range int, batch int, keys binary, several binary"
TOLD = "batch int, range int, answer binary"
CONTEXTS = "range int, batch int, tags binary, owners binary, sizes binary, bytes binary"


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 16-byte strings of ``data``."""
    a = data.astype(np.uint64)
    for width in (1, 2, 4):
        a = a[:-width] | (a[width:] << np.uint64(8 * width))
    n = len(data) - KMER + 1
    h = a[:n] * ODD[0]
    h ^= h >> np.uint64(29)
    h += a[8 : 8 + n]
    h *= ODD[1]
    h ^= h >> np.uint64(32)
    h *= ODD[2]
    h ^= h >> np.uint64(29)
    return h


def minimizers(data: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """K-mer hashes, and for every start of ``depth`` bytes the place of its minimizer (the leftmost of equals)."""
    h = kmer_hashes(data)
    least, place = (h >> np.uint64(32)).astype(np.uint32), np.arange(len(h), dtype=np.int32)
    wide, size = depth - KMER + 1, 1
    while size < wide:
        step = min(size, wide - size)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.minimum(least[step:], least[:-step])
        size += step
    return h, place


class Stretch:
    """Some texts laid end to end. Contexts are (key, from, to): windows from..to-1 have the same minimizer."""

    def __init__(self, texts: list[bytes], numbers: list[int], depth: int):
        self.numbers, self.depth = numbers, depth
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = b"".join(texts)
        self.data = np.frombuffer(self.bytes, np.uint8)
        none = np.zeros(0, np.int64)
        self.keys, self.lo, self.hi, self.of = np.zeros(0, np.uint64), none, none, none
        if len(self.data) < depth:
            return
        hashes, place = minimizers(self.data, depth)
        of = np.repeat(np.arange(len(texts)), self.sizes)[: len(place)]
        whole = np.flatnonzero(np.arange(len(place)) + depth <= (self.starts + self.sizes)[of])
        if not len(whole):
            return
        place, of = place[whole], of[whole]
        heads = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (of[1:] != of[:-1])])
        # minimizers have small hashes by their nature; mixed once more, they spread over all ranges
        self.keys, self.of = hashes[place[heads]] * ODD[0], of[heads]
        self.lo, self.hi = whole[heads], whole[np.r_[heads[1:], len(whole)] - 1] + 1


def stretches(texts: list[bytes], depth: int) -> Iterator[Stretch]:
    held, numbers, size = [], [], 0
    for i, text in enumerate(texts):
        held.append(text)
        numbers.append(i)
        size += len(text)
        if size >= STRETCH:
            yield Stretch(held, numbers, depth)
            held, numbers, size = [], [], 0
    if held:
        yield Stretch(held, numbers, depth)


def _ordered(batch: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes], np.ndarray]:
    """Rows in an order of their own, whatever order they arrive in; their bytes; their owners as unsigned numbers."""
    batch = batch.sort_values(["owner", "text"], kind="stable", ignore_index=True)
    owners = batch["owner"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return batch, [t.encode() for t in batch["text"]], owners


class Found:
    """A batch's contexts whose minimizer occurs in several documents: distinct ones, and where each occurs."""

    def __init__(self, parts: list[Stretch], owners: np.ndarray, shared: np.ndarray, keys: np.ndarray, width: int):
        at: dict[bytes, int] = {}
        of_key, owner = [], []
        self.places = []
        for part in parts:
            mine = np.flatnonzero(shared[np.searchsorted(keys, part.keys)]) if len(keys) else np.zeros(0, np.int64)
            numbers = np.empty(len(mine), np.int64)
            rows = np.asarray(part.numbers)[part.of[mine]]
            spans = zip(part.lo[mine].tolist(), (part.hi[mine] + part.depth - 1).tolist(), strict=True)
            known = len(at)
            for j, (a, b) in enumerate(spans):
                context = part.bytes[a:b]
                numbers[j] = found = at.setdefault(context, known)
                if found == known:
                    known += 1
                    of_key.append(part.keys[mine[j]])
                    owner.append(owners[rows[j]])  # rows come in the order of owners
            self.places.append((part, mine, rows, numbers))
        of_key = np.array(of_key, np.uint64)
        self.tags = of_key.astype(np.uint32)  # tell contexts of different minimizers apart within a range
        ranges = hash_ranges(of_key, width)
        self.order = np.argsort(ranges, kind="stable")
        self.owner = np.array(owner, np.uint64)
        self.contexts = list(at)
        self.cuts = np.searchsorted(ranges[self.order], np.arange(width + 1))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, batch_chars: int = 8_000_000, ranges_per_batch: int = 4,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left), one row per input row.

    A byte goes when ``depth`` bytes over it also start in a document with a smaller id, as the input has them. Null
    texts are empty. Null ids are larger than all others; rows with one id never take bytes from each other. An empty table
    gives an empty result. ``depth`` lies between 17 and 79 (a context's windows have one 64-bit mask).
    """
    if not KMER < depth <= KMER + 63:
        raise ValueError(f"depth must be from {KMER + 1} to {KMER + 63}")
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    width = max(1, -(-chars // batch_chars))
    spread = width * ranges_per_batch
    dealt = rows.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("doc_id", F.lit(LAST)).alias("owner"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("batch", F.pmod(F.xxhash64("owner"), F.lit(width)).cast("int")).repartition(width, "batch")

    def keys_of(parts: list[Stretch], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers, ascending, and which occur in more than one of the batch's documents."""
        keys = np.concatenate([p.keys for p in parts]) if parts else np.zeros(0, np.uint64)
        owner = np.concatenate([owners[np.asarray(p.numbers)[p.of]] for p in parts]) if parts else keys
        by = np.argsort(keys, kind="stable")  # and by owner, as rows come
        keys, owner = keys[by], owner[by]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        tails = np.r_[heads[1:], len(keys)] - 1 if len(keys) else heads
        return keys[heads], owner[heads] != owner[tails]

    def send_keys(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        _, texts, owners = _ordered(batch)
        keys, several = keys_of(list(stretches(texts, depth)), owners)
        cuts = np.searchsorted(hash_ranges(keys, spread), np.arange(spread + 1))
        out = [
            (r, key[0], pack(keys[a:b]), np.packbits(several[a:b]).tobytes())
            for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b
        ]
        return pd.DataFrame(out, columns=["range", "batch", "keys", "several"])

    def tell_shared(key: tuple, packets: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(k) for k in packets["keys"]]
        sizes = [len(k) for k in keys]
        several = [np.unpackbits(np.frombuffer(s, np.uint8))[:n] for s, n in zip(packets["several"], sizes, strict=True)]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        shared = np.bincount(inverse, weights=1 + np.concatenate(several)) > 1
        answers = np.split(shared[inverse], np.cumsum(sizes)[:-1])
        return pd.DataFrame({"batch": packets["batch"], "range": key[0], "answer": [np.packbits(a).tobytes() for a in answers]})

    def found_in(batch: pd.DataFrame, told: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes], Found]:
        batch, texts, owners = _ordered(batch)
        parts = list(stretches(texts, depth))
        keys, _ = keys_of(parts, owners)
        cuts = np.searchsorted(hash_ranges(keys, spread), np.arange(spread + 1))
        shared = np.zeros(len(keys), bool)
        for r, answer in zip(told["range"], told["answer"], strict=True):
            a, b = cuts[r], cuts[r + 1]
            shared[a:b] = np.unpackbits(np.frombuffer(answer, np.uint8))[: b - a]
        return batch, texts, Found(parts, owners, shared, keys, spread)

    def send_contexts(key: tuple, batch: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        _, _, found = found_in(batch, told)
        out = []
        for r, (a, b) in enumerate(zip(found.cuts[:-1], found.cuts[1:], strict=True)):
            if a < b:
                mine = found.order[a:b]
                strings = [found.contexts[i] for i in mine]
                sizes = np.fromiter(map(len, strings), np.uint64, len(strings))
                out.append((r, key[0], found.tags[mine].tobytes(), pack(found.owner[mine]), pack(sizes), b"".join(strings)))
        return pd.DataFrame(out, columns=["range", "batch", "tags", "owners", "sizes", "bytes"])

    def stream(key: tuple, packets: pd.DataFrame) -> pd.DataFrame:
        at: dict[bytes, int] = {}
        numbers, owners = [], []
        for blob, sizes, own in zip(packets["bytes"], packets["sizes"], packets["owners"], strict=True):
            # UTF-8 has no byte 255: it stands for the zero byte, which ends strings in the index
            blob = blob.replace(b"\0", b"\xff")
            ends = np.cumsum(unpack(sizes).astype(np.int64)).tolist()
            numbers.append([at.setdefault(blob[a:b], len(at)) for a, b in zip([0, *ends], ends, strict=False)])
            owners.append(unpack(own))
        of, owner = np.concatenate(numbers), np.concatenate(owners)
        least = np.full(len(at), np.uint64((1 << 64) - 1))
        np.minimum.at(least, of, owner)
        strings, masks = list(at), np.zeros(len(at), np.uint64)
        # equal windows have equal minimizers: a context that is the only one of its minimizer matches itself alone
        tag = np.empty(len(at), np.uint32)
        tag[of] = np.concatenate([np.frombuffer(t, np.uint32) for t in packets["tags"]])
        _, kind, size = np.unique(tag, return_inverse=True, return_counts=True)
        several = np.flatnonzero(size[kind] > 1)
        order = several[np.argsort(least[several], kind="stable")]
        if len(order):
            masks[order] = RunIndex([strings[i] for i in order], least[order], depth).earlier()
        everywhere = np.uint64((1 << 64) - 1)
        answer = np.where(owner > least[of], everywhere, masks[of])
        parts = np.split(answer, np.cumsum([len(n) for n in numbers])[:-1])
        return pd.DataFrame({"batch": packets["batch"], "range": key[0], "answer": [pack(p) for p in parts]})

    def apply(batch: pd.DataFrame, told: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        batch, texts, found = found_in(batch, told)
        masks = np.zeros(len(found.contexts), np.uint64)
        for r, answer in zip(answers["range"], answers["answer"], strict=True):
            masks[found.order[found.cuts[r] : found.cuts[r + 1]]] = unpack(answer)
        owners = batch["owner"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out = [(len(t), 0, 0, t) for t in texts]
        bits = np.arange(64, dtype=np.uint64)
        for part, mine, rows, numbers in found.places:
            mask = np.where(owners[rows] > found.owner[numbers], ~np.uint64(0), masks[numbers])
            hit = np.flatnonzero(mask)
            if not len(hit):
                continue
            lo, n = part.lo[mine[hit]], (part.hi - part.lo)[mine[hit]]
            on = ((mask[hit, None] >> bits) & np.uint64(1)).astype(bool) & (bits[None, :] < n[:, None].astype(np.uint64))
            start = np.zeros(len(part.data) + 1, np.int64)
            start[(lo[:, None] + bits.astype(np.int64))[on]] = 1
            total = np.cumsum(start)
            covered = total[:-1] - np.r_[np.zeros(depth, np.int64), total[: len(part.data) - depth]] > 0
            for j in np.unique(part.of[mine[hit]]):
                span = slice(part.starts[j], part.starts[j] + part.sizes[j])
                gone = covered[span]
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out[part.numbers[j]] = (len(gone), int(gone.sum()), runs, part.data[span][~gone].tobytes())
        done = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
        done["doc_id"] = batch["doc_id"]
        done["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in done["kept"]]
        return done

    packets = dealt.groupBy("batch").applyInPandas(send_keys, SENT)
    told = stored(packets.groupBy("range").applyInPandas(tell_shared, TOLD), "shared-minimizers")
    del packets
    release(spark)
    told_by = told.repartition(width, "batch").groupBy("batch")
    contexts = dealt.groupBy("batch").cogroup(told_by).applyInPandas(send_contexts, CONTEXTS)
    answers = stored(contexts.groupBy("range").applyInPandas(stream, TOLD), "earlier-windows")
    del contexts
    release(spark)
    both = told.withColumn("round", F.lit(1)).unionByName(answers.withColumn("round", F.lit(2)))

    def finish(batch: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        return apply(batch, replies[replies["round"] == 1], replies[replies["round"] == 2])

    return dealt.groupBy("batch").cogroup(both.repartition(width, "batch").groupBy("batch")).applyInPandas(
        finish, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))
