"""Mixing to target weights with soft membership.

A classifier trained on the table of labelled documents gives every document a posterior over domains. The rate of a
document says how often it is to be read. Rates are the nonnegative solution of a least-squares problem: the
expected token totals of the domains, sum over documents of rate x tokens x posterior, shall match the targets,
each error measured against the domain's own total, with a slight pull towards rate 1. It is solved by projected
gradient steps; a step is one pass over a table of tokens and posteriors, which sums one number per domain.
A rate is read as its whole part in copies plus one more where a hash of the document falls below the rest.
``limit`` takes the shares of unwanted domains as upper bounds instead: documents that are most likely of the wanted domain
keep rate 1 however scarce the others are, and the rates of the others, never above 1, fall until their shares hold.

The classifier is a logistic model on which hashed words a text has and a few shape features. Features are chosen by
their counts in all labelled documents: several times as frequent in one domain as overall, beyond chance. Weights are
fitted on a sample of at most about ``SAMPLE`` labelled documents, taken by a hash of doc_id. Several labels of a document
count once, by the worst. Null or empty text has no tokens, prior posteriors and its rate as any other. A null doc_id has
no label. Repeated rows get equal rates. Without labels there is one domain ``unlabelled``. Extra columns are kept by ``apply``.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from . import numeric as N
from . import windows as W

BITS = 15
SHAPES = 64
#: A feature counts when its share in a domain is so many standard errors off its overall share.
SIGNIFICANT, LIFT = 5.0, 2.0
#: Labelled documents that must hold a feature, whatever their number.
OFTEN = 20
#: Labelled documents that the weights are fitted on, passes over them, and the penalty on squared weights.
SAMPLE, PASSES, PENALTY = 8000, 300, 1.0
STEPS, TOLERANCE, PULL = 200, 1e-4, 1e-3


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labelled table: toxic before junk before clean."""
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    domain = F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "junk").when(F.col("q") == 1, "clean")
    return worst.select("doc_id", domain.alias("domain")).where("domain is not null")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature of every distinct (row, feature), and the number of words of each row."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    starts, ends, firsts = N.words(data, offsets)
    tokens = np.diff(firsts)
    lower = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    slot = (N.word_values(lower, starts, ends) >> N.U(64 - BITS)).astype(np.int64)
    row = N.owners(firsts)
    each = np.unique((row << BITS) + slot)
    distinct = np.bincount(each >> BITS, minlength=len(raw))
    size, per = np.maximum(np.diff(offsets), 1), N.owners(offsets)
    shapes = []
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    for mask in ((data >= 65) & (data <= 90), ~letter & ~((data >= 65) & (data <= 90)) & ~N.SEPARATOR[data], (data >= 48) & (data <= 57)):
        shapes.append(np.minimum(np.ceil(16 * np.bincount(per, mask, minlength=len(raw)) / size), 15))
    shapes.append(np.minimum(np.floor(16 * distinct / np.maximum(tokens, 1)), 15))
    rows = np.arange(len(raw))
    extra = [(rows, (1 << BITS) + 16 * i + s.astype(np.int64)) for i, s in enumerate(shapes)]
    return (np.concatenate([each >> BITS, *[r for r, _ in extra]]), np.concatenate([each & ((1 << BITS) - 1), *[f for _, f in extra]]), tokens)


class Classifier:
    """Softmax over chosen features; only present ones add to the score."""

    def __init__(self, names: list[str], sizes: np.ndarray, counts: np.ndarray):
        self.names = names
        share = (counts + 0.5) / (sizes[:, None] + 1)
        total = (counts.sum(axis=0) + 0.5) / (sizes.sum() + 1)
        error = np.sqrt(total * (1 - total) / np.maximum(sizes[:, None], 1))
        often = counts.sum(axis=0) >= OFTEN
        self.use = ((share > LIFT * total) & (share - total > SIGNIFICANT * error)).any(axis=0) & often
        self.base = np.log((sizes + 1) / (sizes.sum() + len(sizes)))
        self.weight = np.zeros(counts.shape)

    def posteriors(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        keep = self.use[feature]
        row, feature = row[keep], feature[keep]
        score = np.stack([b + np.bincount(row, w[feature], minlength=n) for b, w in zip(self.base, self.weight)], axis=1)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def fit(self, row: np.ndarray, feature: np.ndarray, domain: np.ndarray) -> None:
        """Accelerated gradient descent on the penalised log loss, over the rows of the sample."""
        n = len(domain)
        keep = self.use[feature]
        row, feature = row[keep], feature[keep]
        if not len(feature):
            return
        truth = np.eye(len(self.names))[domain]
        # The loss curves by half the largest eigenvalue of the features' squares at most.
        v, size = np.ones(self.weight.shape[1]), 1.0
        for _ in range(20):
            v = np.bincount(feature, np.bincount(row, v[feature], minlength=n)[row], minlength=len(v))
            size = float(np.linalg.norm(v)) or 1.0
            v /= size
        step = 1 / (0.6 * size + PENALTY)
        weight, base = self.weight, self.base
        past = (weight, base)
        for k in range(PASSES):
            ahead = k / (k + 3)
            self.weight, self.base = weight + ahead * (weight - past[0]), base + ahead * (base - past[1])
            off = self.posteriors(row, feature, n) - truth
            slope = np.stack([np.bincount(feature, off[row, c], minlength=weight.shape[1]) for c in range(len(self.names))])
            past = (weight, base)
            weight = self.weight - step * (slope + PENALTY * self.weight)
            base = self.base - 2 * off.mean(axis=0)
        self.weight, self.base = weight, base


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Feature counts of every domain over all labelled documents."""
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(domains(labels).hint("merge"), "doc_id")
    width = (1 << BITS) + SHAPES

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in N.slices(batches, "text"):
            row, feature, _ = features(b.column("text").to_pylist())
            name = np.array(b.column("domain").to_pylist())
            for d in np.unique(name):
                mine = name == d
                have = sums.setdefault(str(d), np.zeros(width + 1, np.int64))
                have[:width] += np.bincount(feature[mine[row]], minlength=width)
                have[width] += int(mine.sum())
        for d, have in sums.items():
            at = np.flatnonzero(have)
            yield W.table({"domain": [d] * len(at), "feature": at, "n": have[at]})

    got = seen.select("text", "domain").mapInArrow(count, "domain string, feature long, n long").groupBy("domain", "feature").agg(
        F.sum("n").alias("n")
    ).toArrow()
    names = sorted(set(got.column("domain").to_pylist())) or ["unlabelled"]
    counts = np.zeros((len(names), width + 1))
    index = np.array([names.index(d) for d in got.column("domain").to_pylist()], np.int64)
    counts[index, got.column("feature").to_numpy()] = got.column("n").to_numpy()
    model = Classifier(names, counts[:, width], counts[:, :width])
    n = int(counts[:, width].sum())
    if not n:
        return model
    share = -(-1_000_000 * SAMPLE // n)
    # At most about SAMPLE rows, so they can be sent to every task.
    picked = domains(labels).where(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1_000_000)) < share)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(picked), "doc_id")

    def sparse(batches):
        for b in N.slices(batches, "text"):
            row, feature, _ = features(b.column("text").to_pylist())
            keep = model.use[feature]
            row, feature = row[keep], feature[keep].astype(np.int32)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(b.num_rows + 1))
            lists = [feature[order[lo:hi]].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([b.column("domain"), pa.array(lists, pa.binary())], names=["domain", "features"])

    rows = sample.select("text", "domain").mapInArrow(sparse, "domain string, features binary").toArrow()
    rows = rows.sort_by([("domain", "ascending"), ("features", "ascending")])
    lists = [np.frombuffer(x, np.int32) for x in rows.column("features").to_pylist()]
    if lists:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        model.fit(row, np.concatenate(lists).astype(np.int64), np.array([names.index(d) for d in rows.column("domain").to_pylist()]))
    return model


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(ka, kb, doc_id, tokens, p) with one posterior per domain."""
    text = W.keyed(docs)

    def score(batches):
        for b in N.slices(batches, "text"):
            row, feature, tokens = features(b.column("text").to_pylist())
            p = model.posteriors(row, feature, b.num_rows)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column("ka"), b.column("kb"), b.column("doc_id"), pa.array(tokens.astype(np.int64)), flat],
                names=["ka", "kb", "doc_id", "tokens", "p"])

    return text.mapInArrow(score, "ka long, kb long, doc_id long, tokens long, p array<double>")


def _rates(p: np.ndarray, errors: list[np.ndarray], wanted: int | None = None) -> np.ndarray:
    """Rates after all steps so far, from rate 1. With a ``wanted`` domain its documents stay at 1 and no rate is above."""
    rate = np.ones(len(p))
    for e in errors:
        rate = np.maximum(0.0, rate - (p @ e + PULL * (rate - 1)) / (1 + PULL))
        if wanted is not None:
            rate = np.where(p.argmax(axis=1) == wanted, 1.0, np.minimum(rate, 1.0))
    return rate


def _matrix(column) -> np.ndarray:
    width = len(column[0]) if len(column) else 1
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def fit_rates(table: DataFrame, model: Classifier, targets: Mapping[str, float], wanted: str | None = None) -> tuple[DataFrame, dict]:
    """The table with a ``rate``, and what was reached. Targets are shares of as many tokens as there are.

    With a ``wanted`` domain the other targets are the largest shares of the tokens that are read; a domain without a
    target has no bound, and without documents of the wanted domain nothing has.
    """
    k = len(model.names)
    sums = [F.sum(F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    row = table.agg(F.sum("tokens").alias("all"), *sums).first()
    have = np.array([float(row[f"s{i}"] or 0) for i in range(k)])
    weight = np.array([float(targets.get(n, 0)) for n in model.names])
    share = weight / max(weight.sum(), 1e-12)
    # Targets of domains that do not exist say nothing: everything keeps rate 1.
    want = share * float(row["all"] or 0) if weight.sum() > 0 else have.copy()
    fixed = model.names.index(wanted) if wanted in model.names else None
    bounded = np.array([fixed is not None and n != wanted and n in targets for n in model.names])
    scale, errors = np.maximum(have, 1e-9 * max(have.sum(), 1.0)), []
    reached, converged = have, False

    def step(batches, errors):
        out = np.zeros(k)
        for b in batches:
            p = _matrix(b.column("p"))
            if len(p):
                out += (_rates(p, errors, fixed) * b.column("tokens").to_numpy()) @ p
        yield W.table({"domain": np.arange(k), "s": out})

    for _ in range(STEPS):
        if wanted is not None:
            want = np.where(bounded, np.minimum(reached, share * reached.sum()), reached)
        errors.append((reached - want) / scale)
        past = list(errors)
        got = table.select("tokens", "p").mapInArrow(lambda b: step(b, past), "domain long, s double").groupBy("domain").agg(F.sum("s").alias("s"))
        before, reached = reached, np.zeros(k)
        for r in got.collect():
            reached[r["domain"]] = r["s"]
        # At the end either the targets are met or the totals stand still, as posteriors need not allow the targets.
        limit = TOLERANCE * max(want.sum(), 1.0)
        if wanted is not None:
            want = np.where(bounded, np.minimum(reached, share * reached.sum()), reached)
        if np.abs(reached - want).max() <= limit or np.abs(reached - before).max() <= 0.5 * limit:
            converged = True
            break
    if not converged:
        raise ValueError(f"rates do not settle within {STEPS} steps: totals {reached.tolist()}, targets {want.tolist()}")

    def give(batches):
        for b in batches:
            p = _matrix(b.column("p"))
            rate = _rates(p, errors, fixed) if len(p) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate)], names=[*b.schema.names, "rate"])

    rated = table.mapInArrow(give, "ka long, kb long, doc_id long, tokens long, p array<double>, rate double")
    part = F.pmod(F.xxhash64(F.lit(23), "ka", "kb"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return rated.withColumn("copies", copies), {"domains": model.names, "have": have, "want": want, "reached": reached, "steps": len(errors)}


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float]) -> tuple[DataFrame, dict]:
    """Rates of all documents. Where no domain with a target exists, as without labels, every rate is 1.

    Targets that the posteriors do not allow end where the totals stand still; the job fails if they still move after ``STEPS`` steps.
    """
    model = train(docs, labels)
    return fit_rates(cut_lineage(posteriors(docs, model)), model, targets)


def limit(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], wanted: str) -> tuple[DataFrame, dict]:
    """Rates of all documents, 1 for those of the ``wanted`` domain; the other targets are upper bounds."""
    model = train(docs, labels)
    return fit_rates(cut_lineage(posteriors(docs, model)), model, targets, wanted)
