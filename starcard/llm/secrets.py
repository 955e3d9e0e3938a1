"""Secret scans: three patterns, and strings that stay novel to a primed compressor.

A candidate is a long run of token characters with letters and digits, in a line that names something
sensitive or in a line next to one. A zstandard compressor is primed with a dictionary of identifiers that are
frequent on such lines all over the corpus, and with the text around the candidate, its own copies taken out;
the candidate's marginal compressed bytes over its length tell how novel it is. Names, words and paths compress
against the dictionary or their surroundings, keys do not. Long strings of a small alphabet are entropy coded, so
they are judged in pieces, and as a whole against what their alphabet allows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcard.llm.common import id_and_text, largest
from starcard.session import stored

#: The base patterns and the lengths they must reach.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones are those that fail
ASSIGNED, ACCESS_KEY = 6, 20
KINDS = ("assign", "access", "hex", "novel")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SENSITIVE = re.compile(r"passw|passphrase|secret|token|api[ _-]?key|credential|private[ _-]?key|bearer|access[ _-]?key", re.I | re.A)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,39}")
SENSITIVE_HINTS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer")
AROUND = 256
#: Characters of a piece: too few for a table of codes to pay.
PIECE = 32


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, leftmost non-overlapping per kind."""
    spans = []
    if any(h in low for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_KEY]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def sensitive_lines(text: str, low: str) -> list[tuple[int, int]]:
    """(start, end) of every line with a sensitive word."""
    if not any(h in low for h in SENSITIVE_HINTS):
        return []
    out, end = [], -1
    for m in SENSITIVE.finditer(text):
        if m.start() < end:
            continue
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        out.append((text.rfind("\n", 0, m.start()) + 1, end))
    return out


def with_neighbours(text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The lines with the line before and the one after, those that touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in lines:
        start = text.rfind("\n", 0, max(0, start - 1)) + 1
        end = text.find("\n", end + 1)
        end = len(text) if end < 0 else end
        if out and start <= out[-1][1]:
            start = out.pop()[0]
        out.append((start, end))
    return out


def novelty(candidate: str, around: str, identifiers: bytes) -> float:
    """Marginal compressed bytes of the candidate per byte, primed with its surroundings (without copies of it) and the identifiers.

    The mean over its pieces; of a longer candidate at most what the whole takes of its alphabet's bits, which falls where
    the candidate repeats itself.
    """
    primed = zstandard.ZstdCompressionDict(
        identifiers + b"\n" + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    press = zstandard.ZstdCompressor(
        level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    data = candidate.encode()
    none = len(press.compress(b""))
    count = -(-len(data) // PIECE)
    cuts = [i * len(data) // count for i in range(count + 1)]
    pieces = sum(len(press.compress(data[a:b])) - none for a, b in zip(cuts, cuts[1:], strict=False)) / len(data)
    if count == 1:
        return pieces
    bits = math.log2(max(2, len(set(data))))
    return min(pieces, (len(press.compress(data)) - none) / len(data) * 8 / bits)


def all_spans(text: str, identifiers: bytes, least: float) -> tuple[list, list]:
    low = text.lower()
    base = base_spans(text, low)
    novel = []
    for start, end in with_neighbours(text, sensitive_lines(text, low)):
        for m in CANDIDATE.finditer(text, start, end):
            if any(s < m.end() and m.start() < e for s, _, e in base):
                continue
            reach = AROUND + len(m[0])  # a copy at the edge is whole within it
            before = text[max(0, m.start() - reach) : m.start()].replace(m[0], "\n")[-AROUND:]
            after = text[m.end() : m.end() + reach].replace(m[0], "\n")[:AROUND]
            if novelty(m[0], before + "\n" + after, identifiers) >= least:
                novel.append((m.start(), 3, m.end()))
    return base, sorted(base + novel)


def identifiers(docs: DataFrame, keep: int = 2000, text_col: str = "text") -> bytes:
    """The about ``keep`` most frequent identifiers of sensitive lines, the commonest last, where a compressor sees them nearest.

    All texts are counted; ``keep`` bounds what is sent to the tasks (at most 40 bytes each).
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                for start, end in sensitive_lines(text, text.lower()):
                    seen.update(w for w in IDENTIFIER.findall(text, start, end) if not any(c.isdigit() for c in w))
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"word": str, "n": "int64"})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    counts = rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = largest(stored(counts.filter("n > 1"), "identifiers"), "n", "word", keep).collect()
    return " ".join(r["word"] for r in sorted(top, key=lambda r: (r["n"], r["word"]))).encode()


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_column(text: Column, spark: SparkSession, words: bytes, least: float) -> Column:
    sent = spark.sparkContext.broadcast(words)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, spans = all_spans(text or "", sent.value, least)
            n = Counter(kind for _, kind, _ in spans)
            rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return run(text)


def scan(docs: DataFrame, least: float = 0.8, keep: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans, one row per input row.

    Spans are code points, end exclusive. ``least`` is the marginal compressed share from which a candidate is
    reported as novel. Null and empty texts have no spans. An empty table gives an empty result.
    """
    words = identifiers(docs, keep, text_col)
    rows = id_and_text(docs, id_col, text_col)
    return rows.select("doc_id", scan_column(F.col("text"), docs.sparkSession, words, least).alias("s")).select("doc_id", "s.*")
