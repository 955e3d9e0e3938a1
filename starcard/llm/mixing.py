"""Mixing to target weights with soft domain membership.

A classifier learnt from a table of labelled documents gives every document a posterior over domains. Rates
r >= 0 per document are then fitted so that the expected tokens per domain, the sum of rate x tokens x
posterior, meet the targets: least squares by projected gradient. A step moves a document's rate along its
posterior, so only as many numbers as there are domains leave the cluster per round, and a document's rate
follows from the rounds' steps and its own posterior alone.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcard.llm.common import free_name, id_and_text, largest
from starcard.session import broadcast_if_small, stored

#: Kinds of characters whose shares tell prose from tables, shouting and noise.
TOGETHER = 1_000  # texts whose features are held at once
KINDS = [string.ascii_uppercase.encode(), b"!", b"|", b"#$%&*", string.digits.encode()]


@dataclass
class DomainModel:
    domains: list[str]
    words: list[str]
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None  # one row per feature and one for the constant
    #: (target, reached) tokens per domain of the last fit, the residual among them.
    reached: dict[str, tuple[float, float]] | None = None

    def features(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(tokens per text, feature rows): character shares, length, variety, and which telling words occur."""
        at = {w: i for i, w in enumerate(self.words)}
        wide = len(KINDS) + 2
        rows, tokens = np.zeros((len(texts), wide + len(at))), np.zeros(len(texts), np.int64)
        for row, (i, text) in zip(rows, enumerate(texts), strict=True):
            data = (text or "").encode()
            words = data.lower().split()
            seen = set(words)
            tokens[i] = len(words)
            row[: len(KINDS)] = [(len(data) - len(data.translate(None, k))) / max(1, len(data)) for k in KINDS]
            row[len(KINDS) : wide] = np.log1p(len(words)), len(seen) / max(1, len(words))
            row[[wide + at[w] for w in (x.decode() for x in seen) if w in at]] = 1.0
        return tokens, rows

    def posteriors(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full((len(rows), len(self.domains)), 1.0 / max(1, len(self.domains)))
        z = ((rows - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _regress(rows: np.ndarray, at: np.ndarray, classes: int, ridge: float = 1e-3, rounds: int = 400):
    """Multinomial logistic regression by accelerated gradient descent on standardised features."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    x = np.ones((len(rows), rows.shape[1] + 1))
    np.subtract(rows, mean, out=x[:, :-1])
    x[:, :-1] /= scale
    y = np.eye(classes)[at]
    step = 1.0 / (0.5 * np.linalg.eigvalsh(x.T @ x)[-1] / len(x) + ridge)
    w = ahead = np.zeros((x.shape[1], classes))
    for i in range(rounds):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (x.T @ (p - y) / len(x) + ridge * ahead)
        ahead, w = new + (i / (i + 3)) * (new - w), new
    return mean, scale, w


def fit_domains(docs: DataFrame, labels: DataFrame, most: int = 20_000, words: int = 200, id_col: str = "doc_id",
                text_col: str = "text") -> DomainModel:
    """Learn from (doc_id, domain) on about ``most`` labelled documents, chosen by a hash of the id; null domains are left out.

    ``most`` bounds the labelled rows, so they can meet the documents by broadcast; ``words`` bounds the model.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("domain").cast("string")).dropna()
    count = known.count()
    if count > most:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (most << 20) // count)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    rows = stored(rows.select("text", "domain"), "labelled")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    if not domains:
        return DomainModel([], [])
    words_of = F.array_distinct(F.split(F.lower("text"), r"[ \t-\r]+"))
    seen = rows.select("domain", F.explode(words_of).alias("word")).groupBy("word", "domain").count()
    size = F.create_map(*[F.lit(x) for d in domains for x in (d, float(sizes[d]))])[F.col("domain")]
    seen = seen.withColumn("p", F.col("count") / size)
    telling = seen.groupBy("word").agg(
        F.max(F.struct("p", "count")).alias("top"), (F.sum("count") / float(sum(sizes.values()))).alias("all")
    ).filter("top.count >= 3").withColumn("value", F.col("top.p") * F.log2(F.col("top.p") / F.col("all")))
    chosen = sorted(r["word"] for r in largest(telling, "value", "word", words).select("word").collect())
    model = DomainModel(domains, chosen)
    bare = vars(model)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"domain": batch["domain"], "x": list(DomainModel(**bare).features(batch["text"])[1])})

    table = rows.mapInPandas(features, "domain string, x array<double>").toArrow().combine_chunks()
    at = np.array([domains.index(d) for d in table.column("domain").to_pylist()])
    found = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(at), -1)
    model.mean, model.scale, model.weights = _regress(found, at, len(domains))
    return model


def membership(text: Column, model: DomainModel, spark: SparkSession) -> Column:
    """Struct (tokens long, p array<double>): words of the text and its posterior in the order of ``model.domains``."""
    sent = spark.sparkContext.broadcast(vars(model))

    @F.pandas_udf("tokens long, p array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = DomainModel(**sent.value)
        for texts in batches:
            tokens, shares = [], []
            for start in range(0, len(texts), TOGETHER):
                n, rows = found.features(texts.iloc[start : start + TOGETHER])
                tokens += n.tolist()
                shares += list(found.posteriors(rows))
            yield pd.DataFrame({"tokens": pd.Series(tokens, dtype="int64"), "p": shares})

    return run(text)


def _rate(p: Column, steps: list[np.ndarray], least: float = 0.0) -> Column:
    """The rate after all steps: start at 1, move along the posterior, never below ``least``."""
    moves = np.array(steps)

    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=float)
        shares, rate = np.stack(rows), np.ones(len(rows))
        for move in moves:
            rate = np.maximum(least, rate - shares @ move)
        return pd.Series(rate)

    return run(p)


def fit_rates(members: DataFrame, targets: np.ndarray, rounds: int = 40, close: float = 2e-3,
              least: float = 0.0) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of the projected gradient over (tokens, p), and the tokens per domain they reach; ``targets`` are tokens per domain.

    Rates are kept at ``least`` or more. The residual is weighted by the inverse of the domains' second moments, so a unit step
    never overshoots and domains that overlap are told apart; documents are scaled by their tokens. It ends when the residual is
    ``close``, doesn't shrink by a thousandth any more, or after ``rounds``; what is reached is returned, so a residual shows.
    """
    k = len(targets)
    second = [F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(k)]
    moments = np.array([float(x or 0.0) for x in members.agg(*second).first()]).reshape(k, k)
    inverse = np.linalg.pinv(moments + 1e-9 * max(1.0, np.trace(moments)) * np.eye(k))
    steps: list[np.ndarray] = []
    before = np.inf
    for left in range(rounds, -1, -1):
        rate = _rate(F.col("p"), steps, least) if steps else F.lit(1.0)
        sums = [F.sum(F.col("rate") * F.col("tokens") * F.col("p")[i]) for i in range(k)]
        now = np.array([float(x or 0.0) for x in members.withColumn("rate", rate).agg(*sums).first()])
        off = float(np.abs(now - targets).sum())
        if not left or off <= close * max(1.0, targets.sum()) or off > 0.999 * before:
            break
        before = off
        steps.append(inverse @ (now - targets))
    return steps, now


def _copies(rate: Column, id_col: str) -> Column:
    """The rate rounded by a hash of the id, so that its expectation is the rate."""
    part = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + part).cast("long")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total_tokens: float | None = None,
        id_col: str = "doc_id", text_col: str = "text", rounds: int = 40, name: str = "_mix", **bounds: int) -> tuple[DataFrame, DomainModel]:
    """``docs`` with a struct ``name`` (tokens, p, rate, copies) added, and the domain model.

    ``weights`` are the domains' target shares of ``total_tokens`` (all tokens of ``docs`` where not given); a labelled domain
    without a weight has target 0, a weight for a domain without labels can't be met and is left unmet. ``copies`` rounds
    the rate by a hash of the id, so its expectation is the rate. Null and empty texts have no tokens and get the rate of
    their posterior. Without labels every document keeps rate 1. Repeated rows are rated each. An empty table stays empty.
    ``model.reached`` tells target and reached tokens by domain. Other columns, whatever their names, are left alone.
    """
    spark = docs.sparkSession
    model = fit_domains(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    member = free_name(docs, "_member")
    placed = docs.withColumn(member, membership(F.col(text_col).cast("string"), model, spark))
    tokens, p = F.col(member)["tokens"], F.col(member)["p"]
    steps: list[np.ndarray] = []
    if model.domains:
        members = stored(placed.select(tokens.alias("tokens"), p.alias("p")), "membership")
        total = total_tokens if total_tokens is not None else float(members.agg(F.sum("tokens")).first()[0] or 0)
        share = sum(weights.values())
        targets = np.array([weights.get(d, 0.0) / share * total for d in model.domains])
        steps, now = fit_rates(members, targets, rounds)
        model.reached = dict(zip(model.domains, zip(targets.tolist(), now.tolist(), strict=True), strict=True))
    rate = free_name(placed, "_rate")
    rated = placed.withColumn(rate, _rate(p, steps) if steps else F.lit(1.0))
    return rated.select(
        *docs.columns, F.struct(tokens.alias("tokens"), p.alias("p"), F.col(rate).alias("rate"), _copies(F.col(rate), id_col).alias("copies")).alias(name)
    ), model


def mix_keeping(docs: DataFrame, labels: DataFrame, keep: str, drop: str, id_col: str = "doc_id", text_col: str = "text",
                rounds: int = 40, name: str = "_mix", **bounds: int) -> tuple[DataFrame, DomainModel]:
    """``docs`` with ``name`` as from ``mix``, the targets taken from the documents themselves; and the domain model.

    A document of ``drop``, by its label, else by its likeliest domain, gets rate 0. The rates of all others are fitted at 1 or
    more: ``keep`` is to gain the tokens dropped, every other domain to stay at what is left of it; a last scaling of what goes beyond 1
    makes the total exact. Membership is 1 or 0 by the label,
    else the posterior. Of a document labelled both ways ``keep`` wins; without a ``keep`` label, ``drop`` does. Without
    anything of ``keep`` the rest stays as it is. An empty table stays empty.
    """
    spark = docs.sparkSession
    model = fit_domains(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    rank = F.when(F.col("domain") == keep, 0).when(F.col("domain") == drop, 1).otherwise(2)
    taken = docs
    member, own_id, label, likeliest = (free_name(taken, c) for c in ("_member", "_id", "_label", "_likeliest"))
    known = labels.select(F.col(id_col).cast("long").alias(own_id), F.col("domain").cast("string").alias("domain")).dropna()
    known = known.groupBy(own_id).agg(F.min(F.struct(rank.alias("r"), "domain"))["domain"].alias(label))
    known, _ = broadcast_if_small(known)
    read = docs.withColumn(member, membership(F.col(text_col).cast("string"), model, spark))
    read = read.join(known, F.col(id_col).cast("long") == F.col(own_id), "left").drop(own_id)
    # One domain learnt tells nothing about documents without a label.
    names = F.array(*[F.lit(d) for d in model.domains]) if len(model.domains) > 1 else None
    soft, tokens = F.col(member)["p"], F.col(member)["tokens"]
    best = F.try_element_at(names, F.array_position(soft, F.array_max(soft)).cast("int")) if names is not None else F.lit(None)
    placed = stored(read.withColumn(likeliest, F.coalesce(F.col(label), best)), "membership")
    hard = F.array(*[(F.col(label) == d).cast("double") for d in model.domains]) if model.domains else soft
    p = F.when(F.col(label).isNotNull(), hard).otherwise(soft if names is not None else F.transform(soft, lambda x: F.lit(0.0)))
    gone = F.coalesce(F.col(likeliest) == drop, F.lit(False))
    steps: list[np.ndarray] = []
    scale = 1.0
    if keep in model.domains:
        members = stored(placed.select(gone.alias("gone"), tokens.alias("tokens"), p.alias("p")), "members")
        stays = members.filter("NOT gone")
        held = stays.agg(*[F.sum(F.col("tokens") * F.col("p")[i]) for i in range(len(model.domains))]).first()
        targets = np.array([float(x or 0.0) for x in held])
        lost = float(members.filter("gone").agg(F.sum("tokens")).first()[0] or 0)
        at = model.domains.index(keep)
        if lost and targets[at] > 0:
            targets[at] += lost
            steps, now = fit_rates(stays.drop("gone"), targets, rounds, least=1.0)
            fitted = stays.withColumn("rate", _rate(F.col("p"), steps, 1.0))
            more = float(fitted.agg(F.sum(F.col("tokens") * (F.col("rate") - 1))).first()[0] or 0)
            scale = lost / more if more else 1.0
            model.reached = dict(zip(model.domains, zip(targets.tolist(), now.tolist(), strict=True), strict=True))
    rate = free_name(placed, "_rate")
    rated = placed.withColumn(rate, F.when(gone, 0.0).otherwise(1 + scale * (_rate(p, steps, 1.0) - 1) if steps else F.lit(1.0)))
    return rated.select(
        *docs.columns, F.struct(tokens.alias("tokens"), soft.alias("p"), F.col(rate).alias("rate"), _copies(F.col(rate), id_col).alias("copies")).alias(name)
    ), model


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic flags: clean, rough, toxic; rows without a flag have no domain."""
    return labels.select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "rough").when(F.col("quality") == 1, "clean").alias("domain")
    )
