"""Packing of token sequences, balanced by estimated cost.

A sequence of pieces of l1, l2, ... tokens costs sum(linear * l + quadratic * l^2): dense layers see every token, attention every pair
of tokens of one document. Documents are taken by falling length; each goes to the sequence of the lowest cost that has room for it, or,
when none has room for all of it, to the one of most room (by power of two) and lowest cost, as far as it fits; what is left over is
taken up again as a shorter document.

A document of more than ``capacity`` tokens first yields pieces of ``capacity``, each the one document that an empty sequence (cost 0)
has room for. Everything happens in one pass over the input without a shuffle: a task gathers rests of documents up to ``group_tokens``
tokens, opens as many sequences as they fill, and takes what finds no room to its next group. Its last group opens sequences of the
powers of two that add up to the tokens left, which need no padding. So no sequence is ever padded, a task holds one group of
documents besides the text in hand, and a lost executor's tasks can run again on their own.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from starcard.llm.common import id_and_text

CAPACITY, END_ID = 2048, 1
VOCABULARY = "byte_bpe_50k"
#: Tokens of rests that a task packs together, and characters of a long text that are encoded at a time.
GROUP_TOKENS, PART_CHARS = 1 << 22, 1 << 16
#: A quadratic term of 1 / (6 x hidden size) of the linear one is that of a transformer; here the hidden size is 1,024.
LINEAR, QUADRATIC = 1.0, 1 / 6144
KIND = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, sequence_cost double"
)
#: Where a text may be cut without changing its ids: no pre-token goes on from a letter or digit to white space.
_CUT = re.compile("[A-Za-z0-9](?=[ \n])")


class Encoder:
    """Ids of a text by a byte-level vocabulary: the faster of two libraries that agree on it, the other one where that gives up.

    Both read the same vocabulary; the tests compare them over all code points. White space by the hundred thousand is
    beyond the first one's stack.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        import tiktoken
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items() if t.special}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _part(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= PART_CHARS:
            return self._part(text)
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + PART_CHARS)
            end = cut.end() if cut else len(text)
            parts.append(self._part(text[at:end]))
            at = end
        return np.concatenate(parts)


def assign(lengths: list[int], rooms: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Deal pieces of ``lengths`` to sequences with ``rooms`` tokens of room.

    Returns the pieces placed as (item, start in it, length, sequence, offset), what found no room as (item, start, length), and
    the costs. Equal lengths are taken in the order given, equal costs by the sequence's number.
    """
    left, cost = list(rooms), [0.0] * len(rooms)
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(max(rooms, default=0).bit_length() + 1)]
    for k, room in enumerate(rooms):
        if room:
            by_room[room.bit_length()].append((0.0, k))
    for heap in by_room:
        heapq.heapify(heap)
    items = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(items)
    placed, over = [], []
    while items:
        length, item, start = heapq.heappop(items)
        length = -length
        size, heap = length.bit_length(), None
        for c in range(size, len(by_room)):  # room of more bits is room enough; of as many bits, for the cheapest one by test
            if by_room[c] and (c > size or left[by_room[c][0][1]] >= length) and (heap is None or by_room[c][0] < heap[0]):
                heap = by_room[c]
        if heap is None:
            heap = next((h for h in reversed(by_room) if h), None)
        if heap is None:
            over.append((item, start, length))
            continue
        _, k = heapq.heappop(heap)
        n = min(length, left[k])
        placed.append((item, start, n, k, rooms[k] - left[k]))
        left[k] -= n
        cost[k] += linear * n + quadratic * n * n
        if left[k]:
            heapq.heappush(by_room[left[k].bit_length()], (cost[k], k))
        if n < length:
            heapq.heappush(items, (n - length, item, start + n))
    return placed, over, cost


class _Packer:
    """Packs the documents of one task."""

    def __init__(self, first_id: int, capacity: int, linear: float, quadratic: float):
        self.next_id, self.capacity, self.weights = first_id, capacity, (linear, quadratic)
        self.rests: list[tuple[int | None, int, int, np.ndarray]] = []  # document, its tokens, start, ids
        self.tokens, self.rows = 0, []

    def _emit(self, doc, total, start, ids, sequence, offset, tokens, cost) -> None:
        crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
        self.rows.append((doc, start, len(ids), crc, total, sequence, offset, tokens, cost))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, cap, (linear, quadratic) = len(ids), self.capacity, self.weights
        full = total - total % cap
        for start in range(0, full, cap):
            self._emit(doc, total, start, ids[start : start + cap], self.next_id, 0, cap, linear * cap + quadratic * cap * cap)
            self.next_id += 1
        if total > full:
            self.rests.append((doc, total, full, ids[full:].copy() if full else ids))
            self.tokens += total - full

    def pack(self, last: bool) -> None:
        many, rest = divmod(self.tokens, self.capacity)
        rooms = [self.capacity] * many + ([1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1] if last else [])
        # ties by document and start keep the result apart from the order of the rows
        items = sorted(self.rests, key=lambda r: (-len(r[3]), r[0] is not None, r[0] or 0, r[2]))
        placed, over, cost = assign([len(r[3]) for r in items], rooms, *self.weights)
        for item, start, n, k, offset in placed:
            doc, total, at, ids = items[item]
            self._emit(doc, total, at + start, ids[start : start + n], self.next_id + k, offset, rooms[k], cost[k])
        self.next_id += len(rooms)
        self.rests = [(*items[i][:2], items[i][2] + s, items[i][3][s : s + n].copy()) for i, s, n in over]
        self.tokens = sum(n for _, _, n in over)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
        kinds = [pa.int64()] * 8 + [pa.float64()]
        names = [c.split()[0] for c in KIND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: its document, place there, length and crc32 of ids, and its sequence and place there.

    ``vocabulary`` is the name of a public byte-level vocabulary. A null or empty text is its end id alone; rows of one id, or of
    none, are documents of their own; an empty table has no pieces; further columns are not looked at. Sequences are full or, at
    the end of a task, powers of two, and are numbered task * 2^32 + place in the task. Cost is balanced among the
    sequences of a group; where the input is sorted by length, ``repartition`` it first to mix groups.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(vocabulary), TaskContext.get()
        packer = _Packer((task.partitionId() if task else 0) << 32, capacity, linear, quadratic)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.append(encoder.ids(text.as_py() or ""), np.uint32(end_id)))
                if packer.tokens >= group_tokens:
                    packer.pack(last=False)
                if len(packer.rows) >= 20_000:
                    yield packer.taken()
        packer.pack(last=True)
        yield packer.taken()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, KIND)
