"""An n-gram language model by deleted interpolation, learnt from and applied to whole corpora.

P(w | h) mixes the maximum-likelihood estimates of all orders and a uniform one. The weights depend on how
often the longest context was seen (a bucket per power of two) and are learnt by expectation-maximisation on
held-out counts: every training token is scored with the counts of all others, its own occurrence deleted.

Documents are dealt into batches by their id. A batch sends its distinct n-grams, as sorted 64-bit hashes in
packets, one packet per range of hashes; each range adds up the packets and answers with the corpus counts in
the packets' order. Batch and answers then meet once more, for the weights and for the scores. So no task
holds more than a batch or a range, whatever the corpus, and a frequent word is one number per batch.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcard.llm.common import fold_of, hash_ranges, id_and_text, pack, release, unpack
from starcard.session import stored

#: Multipliers of a 64-bit mixing function.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Steps per octave in which probabilities are told apart when weights are learnt.
STEPS = 4
NEVER = -(10**6)
PACKETS = "range int, batch int, level int, keys binary, counts binary"
ANSWERS = "batch int, range int, level int, counts binary, types long, tokens long"


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(MIX[0]) + right
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


class Tokens:
    """The n-grams of a batch of texts. Every text ends in one end token, which is also what precedes a text."""

    def __init__(self, texts, order: int):
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        parts, sizes = [], []
        for text in texts:
            words = (text or "").encode().lower().split()
            words.append(b"")
            sizes.append(len(words))
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
        end = np.uint64(xxhash.xxh64_intdigest(b""))
        self.sizes = np.array(sizes)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        token = hashes[np.concatenate(parts)]
        self.first = np.zeros(len(token), bool)
        self.first[self.starts] = True
        self.levels, self.inverse = [], []
        before = None
        for level in range(order):
            if level == 0:
                grams = token
            else:  # what stands before: the lower-order n-gram that ends one token earlier
                context = np.r_[before[-1:], before[:-1]] if level > 1 else np.r_[end, token[:-1]]
                if level > 1:
                    context = np.where(self.first, end, context)
                grams = _mix(context, token)
            keys, inverse = np.unique(grams, return_inverse=True)
            self.levels.append(keys)
            self.inverse.append(inverse)
            before = grams
        self.end_at = int(np.searchsorted(self.levels[0], end))

    def counts(self, answers: pd.DataFrame) -> list[np.ndarray]:
        """Corpus counts of every token's n-grams, lowest order first."""
        out = []
        for level, inverse in enumerate(self.inverse):
            rows = answers[answers["level"] == level].sort_values("range")
            of_key = np.concatenate([unpack(c) for c in rows["counts"]]).astype(np.float64)
            out.append(of_key[inverse])
            if level == 0:
                self.texts = of_key[self.end_at]
        return out

    def contexts(self, counts: list[np.ndarray]) -> list[np.ndarray]:
        """How often the context of each token was seen, for every order above one."""
        return [np.where(self.first, self.texts, np.r_[0.0, c[:-1]]) for c in counts[:-1]]


def _bucket(seen: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than its power of two."""
    return np.where(seen > 0, np.floor(np.log2(np.maximum(seen, 1))) + 1, 0).astype(np.int64)


def _step(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.rint(STEPS * np.log2(np.maximum(p, 1e-300))), NEVER).astype(np.int64)


def count_cells(columns: list[np.ndarray], names: list[str]) -> pd.DataFrame:
    """Distinct combinations of integers and how often each occurs, as ``n``; a pair of columns is numbered at a time."""
    code = np.zeros(len(columns[0]), np.int64)
    firsts = np.zeros(min(1, len(code)), np.int64)
    for column in columns:
        low = int(column.min(initial=0))
        width = int(column.max(initial=0)) - low + 1
        _, firsts, code = np.unique(code * width + (column - low), return_index=True, return_inverse=True)
    out = pd.DataFrame({name: column[firsts] for name, column in zip(names, columns, strict=True)})
    return out.assign(n=np.bincount(code, minlength=len(firsts)))


def learn_weights(cells: pd.DataFrame, order: int, types: int, rounds: int = 60) -> dict[int, np.ndarray]:
    """Weights (uniform, then orders 1 to n) per bucket, by expectation-maximisation over counted cells."""
    out = {}
    for bucket, rows in cells.groupby("bucket"):
        p = np.column_stack(
            [np.full(len(rows), 1.0 / (types + 1))]
            + [np.where(rows[f"q{k}"] == NEVER, 0.0, 2.0 ** (rows[f"q{k}"] / STEPS)) for k in range(1, order + 1)]
        )
        n = rows["n"].to_numpy(float)
        weights = np.full(order + 1, 1.0 / (order + 1))
        for _ in range(rounds):
            share = p * weights
            share /= share.sum(axis=1, keepdims=True)
            weights = n @ share / n.sum()
        out[int(bucket)] = weights
    return out


def _table(weights: dict[int, np.ndarray], order: int) -> np.ndarray:
    """Weights for every bucket; a bucket that training never met takes those of the nearest below, else above."""
    width = 66
    known = sorted(weights)
    if not known:
        return np.full((width, order + 1), 1.0 / (order + 1))
    near = [max([b for b in known if b <= i], default=known[0]) for i in range(width)]
    return np.array([weights[b] for b in near])


def score_corpus(docs: DataFrame, folds: int = 7, held_out: int = 2, order: int = 2, batch_chars: int = 8_000_000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents outside the held-out fold and score all of them.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (this model), both as
    log10 of the text's probability. A-Z is lower-cased, tokens are runs without white space and an end. Null and
    empty texts are an end alone; a null doc_id counts as the empty text for the fold. Repeated rows are learnt from
    and scored each. Without training rows all words are unknown. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    width = max(1, -(-chars // batch_chars))
    dealt = rows.select(
        F.col("doc_id").cast("string").alias("doc_id"), "text",  # as text, a null id leaves the others whole
        (fold_of(F.col("doc_id"), folds) == held_out).alias("held"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(width)).cast("int").alias("batch"),
    ).repartition(width, "batch")

    def send(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens(batch["text"], order)
        taught = np.repeat(~batch["held"].to_numpy(bool), tokens.sizes)
        out = []
        for level, (keys, inverse) in enumerate(zip(tokens.levels, tokens.inverse, strict=True)):
            counts = np.bincount(inverse, weights=taught, minlength=len(keys)).astype(np.uint64)
            cuts = np.searchsorted(hash_ranges(keys, width), np.arange(width + 1))
            out += [
                (r, key[0], level, pack(keys[a:b]), pack(counts[a:b]))
                for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b
            ]
        return pd.DataFrame(out, columns=["range", "batch", "level", "keys", "counts"])

    def answer(key: tuple, packets: pd.DataFrame) -> pd.DataFrame:
        out = []
        for level, own in packets.groupby("level"):
            keys = [unpack(k) for k in own["keys"]]
            sizes = np.cumsum([len(k) for k in keys])[:-1]
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.concatenate([unpack(c) for c in own["counts"]]).astype(np.float64)
            totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
            replies = np.split(totals[inverse], sizes)
            types, seen = int((totals > 0).sum()), int(totals.sum())
            for i, (b, reply) in enumerate(zip(own["batch"], replies, strict=True)):
                out.append((b, key[0], level, pack(reply), types * (i == 0), seen * (i == 0)))
        return pd.DataFrame(out, columns=["batch", "range", "level", "counts", "types", "tokens"])

    packets = dealt.groupBy("batch").applyInPandas(send, PACKETS)
    answers = stored(packets.groupBy("range").applyInPandas(answer, ANSWERS), "ngram-counts")
    release(docs.sparkSession)
    total = answers.filter("level = 0").agg(F.sum("types"), F.sum("tokens")).first()
    types, n_train = int(total[0] or 0), int(total[1] or 0)
    by_batch = answers.select("batch", "range", "level", "counts").repartition(width, "batch")
    met = dealt.groupBy("batch").cogroup(by_batch.groupBy("batch"))
    steps = [f"q{k}" for k in range(1, order + 1)]

    def held_out_cells(batch: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens(batch["text"], order)
        counts = tokens.counts(replies)
        taught = np.repeat(~batch["held"].to_numpy(bool), tokens.sizes)
        contexts = [c[taught] - 1 for c in tokens.contexts(counts)]
        counts = [c[taught] - 1 for c in counts]
        del tokens  # a worker's memory is what its batch holds at once
        columns = [_bucket(contexts[-1]) if contexts else np.zeros(len(counts[0]), np.int64)]
        columns.append(_step(counts[0] / max(1, n_train - 1)))
        for c, context in zip(counts[1:], contexts, strict=True):
            columns.append(_step(c / np.maximum(context, 1)))
        del counts, contexts
        return count_cells(columns, ["bucket", *steps])

    cells = met.applyInPandas(held_out_cells, "bucket long, " + ", ".join(f"{s} long" for s in steps) + ", n long")
    learnt = learn_weights(cells.groupBy("bucket", *steps).agg(F.sum("n").alias("n")).toPandas(), order, types)
    table = _table(learnt, order)
    release(docs.sparkSession)

    def score(batch: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens(batch["text"], order)
        counts = tokens.counts(replies)
        contexts = tokens.contexts(counts)
        bucket = _bucket(contexts[-1]) if contexts else np.zeros(len(counts[0]), np.int64)
        mixed, mass = table[bucket, 0] * (1.0 / (types + 1)), table[bucket, 0]
        for k, c in enumerate(counts, 1):  # orders whose context was never seen leave their weight to the others
            context = np.full(len(c), float(n_train)) if k == 1 else contexts[k - 2]
            weight = np.where(context > 0, table[bucket, k], 0.0)
            mixed = mixed + weight * (c / np.maximum(context, 1))
            mass = mass + weight
        mixed /= mass
        base = np.log10((counts[0] + 1) / (n_train + types + 1))
        return pd.DataFrame({
            "doc_id": batch["doc_id"], "held_out": batch["held"], "n_tokens": tokens.sizes,
            "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), tokens.starts), "train_tokens": n_train,
            "base_score": np.add.reduceat(base, tokens.starts), "score": np.add.reduceat(np.log10(mixed), tokens.starts),
        })

    return met.applyInPandas(
        score, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))
