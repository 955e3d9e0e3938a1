"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from a model file: a normaliser (space to the meta symbol, one in front), the
pieces as arcs, and byte arcs for characters without a piece. Composed with a text it is a lattice over
the text's positions; the encoding is its shortest path in the tropical semiring. In a unigram model an arc
weighs minus its piece's score. In a merge (BPE) model an arc may only follow an arc whose piece it would
stand beside after merging (else its weight is infinite), and that leaves exactly one path.

No piece holds the meta symbol behind another character, so paths of neighbouring words are
independent: words are composed on their own and the results kept per task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starcard.llm.common import id_and_text

META = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words and pairs of pieces that a task remembers before it starts anew; characters that are encoded together.
WORDS_KEPT, PAIRS_KEPT, TOGETHER = 120_000, 250_000, 1 << 20
INFINITE = float("inf")
NOTHING: dict = {}


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and normaliser settings of a model file, as plain values that travel to the tasks."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with an identity normaliser that keeps white space are supported")
    return {
        "merges": model.trainer_spec.model_type == proto.TrainerSpec.BPE,
        "prefix": norm.add_dummy_prefix,
        "pieces": [p.piece for p in model.pieces],
        "scores": [p.score for p in model.pieces],
        "kinds": [p.type for p in model.pieces],
    }


class Transducer:
    #: The model format's numbers for pieces of text, bytes and the unknown piece.
    TEXT, BYTE, UNKNOWN = (1, 4), 6, 2

    def __init__(self, merges: bool, prefix: bool, pieces: list[str], scores: list[float], kinds: list[int]):
        self.merges, self.prefix, self.pieces, self.scores = merges, prefix, pieces, scores
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in self.TEXT}
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == self.BYTE}
        self.unknown = kinds.index(self.UNKNOWN)
        self.arcs: dict = {}  # nested by character, the last one first; the id of a piece lies under ""
        for p, i in self.ids.items():
            node = self.arcs
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        alone = all(META not in p.lstrip(META) for p in self.ids)
        self.units = re.compile(f"{META}*[^{META}]+|{META}+" if alone else r"(?s).+")
        spoken = [p.encode() if k in self.TEXT else b"" for p, k in zip(pieces, kinds, strict=True)]
        for value, i in self.bytes.items():
            spoken[i] = bytes([value])
        self.spoken = np.frombuffer(b"".join(spoken), np.uint8)
        self.spoken_sizes = np.fromiter(map(len, spoken), np.int64, len(spoken))
        self.spoken_starts = np.cumsum(self.spoken_sizes) - self.spoken_sizes
        self.beside: dict[int, bool] = {}
        self.edges: dict[int, tuple] = {}
        self.kept: dict[str, bytes] = {}
        self.least = min(scores) - 10.0

    def normalise(self, text: str) -> str:
        return ((" " if self.prefix and text else "") + text).replace(" ", META)

    def _merged(self, text: str) -> tuple[list[str], list, list]:
        """Merge the neighbours with the best piece, leftmost among equals, until none are left.

        Also what stood first and last in turn, as (part, score at which it came to be).
        """
        parts = list(text)
        first, last = [(parts[0], INFINITE)], [(parts[-1], INFINITE)]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                return parts, first, last
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                first.append((parts[0], best))
            if at == len(parts) - 1:
                last.append((parts[-1], best))

    def _edge(self, piece: int) -> tuple:
        """What stood at the piece's start and end while it was merged: (part, came at, went at) each."""
        found = self.edges.get(piece)
        if found is None:
            _, *sides = self._merged(self.pieces[piece])
            found = self.edges[piece] = tuple(
                [(p, s, e) for (p, s), e in zip(side, [x[1] for x in side[1:]] + [-INFINITE], strict=True)]
                for side in sides
            )
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether the two pieces stay apart when their text is merged.

        They don't if parts that meet at the border at some time form a piece that ranks before what takes either away.
        """
        a, b = self.pieces[left], self.pieces[right]
        if a[-1] == META == b[0]:  # runs of spaces have pieces of equal score
            return self._merged(a + b)[0] == [a, b]
        for x, x_came, x_went in self._edge(left)[1]:
            for y, y_came, y_went in self._edge(right)[0]:
                if max(x_went, y_went) < min(x_came, y_came):
                    piece = self.ids.get(x + y)
                    if piece is not None and self.scores[piece] > x_went and self.scores[piece] >= y_went:
                        return False
        return True

    def paths(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """The shortest path over the lattice of every word, words in order.

        The best way to a place depends on what lies before it alone, so a word goes on where it leaves the one before.
        """
        arcs, beside, merges, scores, follows = self.arcs, self.beside, self.merges, self.scores, self.follows
        cost: list[float | None] = [0.0]
        back, origin = [-1], [0]  # the piece that ends at a place, -1 for a character that stands for its bytes
        before = ""
        for word in sorted(words):
            n, same = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del cost[same + 1 :], back[same + 1 :], origin[same + 1 :]
            before = word
            for j in range(same, n):
                node, i, best, at, start = arcs, j, None, -1, j
                while i >= 0:
                    node = node.get(word[i])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is not None and cost[i] is not None:
                        if merges:
                            left = back[i]
                            if left >= 0:
                                pair = left << 32 | piece
                                apart = beside.get(pair)
                                if apart is None:
                                    if len(beside) > PAIRS_KEPT:
                                        beside.clear()
                                    apart = beside[pair] = follows(left, piece)
                            else:
                                apart = True
                            if apart:  # one path only reaches a place
                                best, at, start = cost[i] + 1.0, piece, i
                                break
                        else:
                            total = cost[i] - scores[piece]
                            if best is None or total < best:
                                best, at, start = total, piece, i
                    i -= 1
                if best is None and "" not in arcs.get(word[j], NOTHING) and cost[j] is not None:
                    best = cost[j] - self.least
                cost.append(best)
                back.append(at)
                origin.append(start)
            out: list[int] = []
            j = n
            while j:
                if back[j] >= 0:
                    out.append(back[j])
                elif self.bytes:
                    out += [self.bytes[b] for b in reversed(word[j - 1].encode("utf-8", "surrogatepass"))]
                else:
                    out.append(self.unknown)
                j = origin[j]
            out.reverse()
            yield word, out

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of every text; texts are taken together until they hold ``TOGETHER`` characters."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.units.findall(self.normalise(text or "")))
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        kept = self.kept
        if len(kept) > WORDS_KEPT:
            kept.clear()
        for word, ids in self.paths(set(chain.from_iterable(held)).difference(kept)):
            kept[word] = np.array(ids, np.int32).tobytes()
        for words in held:
            yield np.frombuffer(b"".join(map(kept.__getitem__, words)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.spoken_sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.spoken_starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        text = self.spoken[places].tobytes().decode("utf-8", "replace").replace(META, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _made(spark: SparkSession, path: str):
    """The model's tables as a broadcast, bounded by the model file."""
    return spark.sparkContext.broadcast(read_model(path))


def encode(text: Column, spark: SparkSession, path: str = MODEL) -> Column:
    """array<int> of piece ids; null and empty text give an empty array."""
    sent = _made(spark, path)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fst = Transducer(**sent.value)
        for texts in batches:
            yield pd.Series(list(fst.encode_all(texts)))

    return run(text)


def decode(ids: Column, spark: SparkSession, path: str = MODEL) -> Column:
    """The text of piece ids: bytes joined, meta symbols back to spaces, the space in front dropped."""
    sent = _made(spark, path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fst = Transducer(**sent.value)
        for rows in batches:
            yield pd.Series([None if r is None else fst.decode(np.asarray(r)) for r in rows])

    return run(ids)


CODED = "piece_ids array<int>, n_pieces int, decoded_sha256 string, round_trip boolean"
#: Rows of an Arrow batch that are coded before their result leaves the task.
ROWS = 512


def with_pieces(docs: DataFrame, path: str = MODEL, text_col: str = "text") -> DataFrame:
    """``docs`` with piece_ids, n_pieces, decoded_sha256 and round_trip added: every text encoded, decoded and compared.

    Null counts as empty; an empty text has no pieces. A meta symbol in a text reads as a space, as the model's
    normaliser has it, so ``round_trip`` compares with the text after that replacement. Every row has its own result,
    repeated ones too. An empty table gives an empty result. Rows pass in small groups, so long texts need no room
    beside their own.
    """
    sent = _made(docs.sparkSession, path)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = Transducer(**sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                texts = [t or "" for t in rows.column(at).to_pylist()]
                ids, digests, same = [], [], []
                for text, coded in zip(texts, fst.encode_all(texts), strict=True):
                    back = fst.decode(coded)
                    ids.append(coded)
                    digests.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == text.replace(META, " "))
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, lists, pa.array(sizes), pa.array(digests, pa.string()), pa.array(same)],
                    [*rows.schema.names, "piece_ids", "n_pieces", "decoded_sha256", "round_trip"],
                )

    added = docs.sparkSession.createDataFrame([], CODED).schema
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def round_trip(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256, exact of ``with_pieces``."""
    return with_pieces(id_and_text(docs, id_col, text_col), path).select(
        "doc_id", "n_pieces", F.col("piece_ids").alias("ids"), "decoded_sha256", F.col("round_trip").alias("exact")
    )
