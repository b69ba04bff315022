"""Quality scores by a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Boosting goes round the features: each turn fits a shallow tree to the
gradients by bin and adds it, shrunk, to the feature's lookup table; then the strongest pairs of features get
tables of their own. A score is the sum of one table entry a feature and pair, through the logistic function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, byte_set, map_chunks, text_bytes, word_hashes

FEATURES = ["log_bytes", "upper", "digits", "ascii_marks", "rare_marks", "other_bytes", "line_ends", "words", "word_bytes", "word_spread", "short_words", "distinct_words", "repeats", "top_word", "distinct_lines", "marked_words"]
_CLASSES = [byte_set((0x41, 0x5A)), byte_set((0x30, 0x39)), byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)), byte_set((0x21, 0x21), (0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E)), byte_set((0x80, 0xFF)), byte_set((0x0A, 0x0A))]
_LINES = ~byte_set((0x0A, 0x0A))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text is all zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets)
    safe = np.maximum(size, 1)
    out[:, 0] = np.log1p(size)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / safe

    for i, lut in enumerate(_CLASSES):
        out[:, i + 1] = share(lut[data])
    words, starts, ends, at = word_hashes(data, offsets, SPACE_WORDS)
    lines, _, _, line_at = word_hashes(data, offsets, _LINES)
    length = (ends - starts).astype(float)
    marked = _CLASSES[3][data[ends - 1]] if len(ends) else np.empty(0, bool)
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b == a:
            continue
        own, size_of = words[a:b], length[a:b]
        _, counts = np.unique(own, return_counts=True)
        out[i, 7:14] = np.log1p(b - a), size_of.mean(), size_of.std(), (size_of <= 3).mean(), len(counts) / np.sqrt(b - a), (own[1:] == own[:-1]).mean() if b - a > 1 else 0.0, counts.max() / (b - a)
        c, d = line_at[i], line_at[i + 1]
        out[i, 14] = len(np.unique(lines[c:d])) / max(d - c, 1)
        out[i, 15] = marked[a:b].mean()
    return out


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree of at most `leaves` ranges of bins, split where the gain is largest."""
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    ridge = 1.0
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = score(a, cut) + (g[b] - g[cut]) ** 2 / (h[b] - h[cut] + ridge) - score(a, b)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], k, int(cut[j]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.empty(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


@dataclass
class Additive:
    """Cut points and lookup tables."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    base: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, pair_bins: int = 8, n_pairs: int = 6, pair_rounds: int = 40) -> Additive:
        """Without two classes the model is constant: the share of label 1, or a half without rows."""
        n_features = x.shape[1]
        share = (y.sum() + 0.5) / (len(y) + 1)
        base = float(np.log(share / (1 - share)))
        quantiles = lambda k: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1])) if len(x) else np.empty(0) for f in range(n_features)]
        cuts, coarse = quantiles(bins), quantiles(pair_bins)
        model = Additive(cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [], [], base)
        if len(np.unique(y)) < 2:
            return model
        code = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
        logit = np.full(len(y), base)

        def gradients() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-logit))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for f in range(n_features):
                g, h = gradients()
                size = len(model.tables[f])
                step = rate * _tree(np.bincount(code[f], g, size), np.bincount(code[f], h, size), 4)
                model.tables[f] += step
                logit += step[code[f]]
        rough = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]
        g, h = gradients()

        def cells(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            wide = len(coarse[j]) + 1
            cell = rough[i] * wide + rough[j]
            size = (len(coarse[i]) + 1) * wide
            return cell, np.bincount(cell, g, size), np.bincount(cell, h, size)

        gain = {}
        for i in range(n_features):
            for j in range(i + 1, n_features):
                _, a, b = cells(i, j, g, h)
                gain[i, j] = float((a**2 / (b + 5.0)).sum())
        model.pairs = sorted(gain, key=gain.get, reverse=True)[:n_pairs]
        model.pair_tables = [np.zeros((len(coarse[i]) + 1) * (len(coarse[j]) + 1)) for i, j in model.pairs]
        for _ in range(pair_rounds):
            for k, (i, j) in enumerate(model.pairs):
                cell, a, b = cells(i, j, *gradients())
                step = rate * a / (b + 5.0)
                model.pair_tables[k] += step
                logit += step[cell]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        for f, (c, table) in enumerate(zip(self.cuts, self.tables)):
            logit += table[np.searchsorted(c, x[:, f], "right")]
        rough = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for pair in self.pairs for f in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            logit += table[rough[i] * (len(self.coarse[j]) + 1) + rough[j]]
        return 1 / (1 + np.exp(-logit))


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Additive:
    """The model from at most `rows` labelled documents (smallest hashes of doc_id) outside the held-out fold.

    labels: doc_id, quality (0 or 1); repeated labels are settled by the majority (a tie is 1); rows with a null are ignored.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold_of(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality")  # at most `rows` rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(*text_bytes(batch.column(0)))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])

    got = map_chunks(some, run, "quality int, x array<double>").toArrow().to_pydict()
    x = np.array(got["x"], float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # so that the model does not depend on the order of tasks
    return Additive.fit(x[order], np.array(got["quality"], float)[order])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs.

    docs: doc_id, text; more columns are ignored. score is the model's chance of label 1 from the text alone; a null
    text counts as empty and has a score like any other. A null doc_id is not held out. Repeated rows get the same score.
    """
    return scored(docs.select("doc_id", "text"), fit_quality(docs, labels, rows)).select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scored(docs: DataFrame, model: Additive) -> DataFrame:
    """docs with a score column in place of any of that name."""
    docs = docs.drop("score")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(*text_bytes(batch.column(batch.schema.get_field_index("text"))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_chunks(docs, run, f"{schema}, score double")
