"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its surroundings.

Candidates are the patterns' findings and all other tokens of eight characters or more that mix letters and digits. The
network is trained on labelled findings (a bounded sample of documents: the patterns' values against other tokens of the
same texts), its outputs are calibrated by a logistic fit on held-out findings, and its threshold is the largest that
keeps the asked recall there. Patterns' findings stay in any case; candidates over the threshold are added. A long
candidate is shown to the network piece by piece and scores as its likeliest piece does.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks

KINDS = ["assign", "access", "hex"]
#: The contract's patterns; hex runs are maximal, so the least length can stand in the pattern.
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: For a first look at whole columns.
LOOK = {"assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "cnn": "[A-Za-z0-9+/_.=-]{8}"}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
OTHER_TOKEN = re.compile(r"[^\s\"'=:,;()]{8,}")
LEFT, BODY, RIGHT, SHORT = 24, 48, 8, 20
WIDTH = LEFT + BODY + RIGHT
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\"'=:_-+/.,;()@<>"
SYMBOLS = len(_ALPHABET) + 2
_CODE = {c: i + 2 for i, c in enumerate(_ALPHABET)}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    body: int
    body_end: int


def base_spans(text: str, kinds: tuple[bool, bool, bool] = (True, True, True)) -> list[Span]:
    """The patterns' findings, by start and then kind; body is the secret itself."""
    out = []
    if kinds[0]:
        out += [Span("assign", *m.span(), *m.span(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if kinds[1]:
        out += [Span("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if kinds[2]:
        out += [Span("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def other_candidates(text: str, base: list[Span]) -> list[Span]:
    """Tokens of eight characters or more of the contract's alphabet, with letters and digits, that no finding touches. Full stops at the end are not theirs."""
    out = []
    for m in CANDIDATE.finditer(text):
        own = m.group().rstrip(".")
        start, end = m.start(), m.start() + len(own)
        if len(own) >= 8 and any(c.isdigit() for c in own) and any(c.isalpha() for c in own) and not any(b.start < end and start < b.end for b in base):
            out.append(Span("cnn", start, end, start, end))
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of at most BODY characters and of what stands around them; 0 is nothing, 1 any other character."""
    get = _CODE.get
    left, body, right = text[max(0, start - LEFT) : start], text[start:end], text[end : end + RIGHT]
    return np.array([0] * (LEFT - len(left)) + [get(c, 1) for c in left] + [get(c, 1) for c in body] + [0] * (BODY - len(body)) + [get(c, 1) for c in right] + [0] * (RIGHT - len(right)), np.int16)


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """A window for each BODY characters of a candidate, the last one ending where it ends."""
    return [window(text, max(start, min(at, end - BODY)), min(at + BODY, end)) for at in range(start, end, BODY)]


@dataclass
class Network:
    """Embedding, one convolution, maximum and mean over places, a logistic output, and its calibration."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    width: int = 5

    @staticmethod
    def start(embed: int = 8, filters: int = 24, width: int = 5, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        shape = {"embed": (SYMBOLS, embed), "filter": (width * embed, filters), "bias": (filters,), "out": (2 * filters,), "base": (1,)}
        return Network({k: (rng.normal(0, 1 / np.sqrt(max(s[0], 8)), s) if k not in ("bias", "base") else np.zeros(s)).astype(np.float32) for k, s in shape.items()}, width=width)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        e = w["embed"][x]
        n = x.shape[1] - self.width + 1
        cols = np.concatenate([e[:, j : j + n] for j in range(self.width)], axis=2)
        z = np.maximum(cols @ w["filter"] + w["bias"], 0)
        top = z.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(z, top[:, None, :], 1)[:, 0], z.mean(axis=1)), axis=1)
        return cols, z, top, pooled, pooled @ w["out"] + w["base"]

    def logits(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + batch])[4] for i in range(0, len(x), batch)]) if len(x) else np.empty(0, np.float32)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(x) + self.shift)))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        cols, z, top, pooled, logit = self._forward(x)
        d = (1 / (1 + np.exp(-logit)) - y) / len(x)
        filters = z.shape[2]
        d_pool = d[:, None] * w["out"]
        dz = np.repeat(d_pool[:, None, filters:] / z.shape[1], z.shape[1], axis=1)
        rows = np.arange(len(x))[:, None]
        dz[rows, top, np.arange(filters)] += d_pool[:, :filters]
        dz *= z > 0
        d_cols = dz @ w["filter"].T
        size, n = w["embed"].shape[1], z.shape[1]
        d_embed = np.zeros_like(w["embed"])
        for j in range(self.width):
            np.add.at(d_embed, x[:, j : j + n], d_cols[:, :, j * size : (j + 1) * size])
        return {"embed": d_embed, "filter": np.tensordot(cols, dz, ((0, 1), (0, 1))), "bias": dz.sum(axis=(0, 1)), "out": pooled.T @ d, "base": d.sum(keepdims=True)}

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, recall: float = 0.98, epochs: int = 10, seed: int = 5, group: np.ndarray | None = None) -> Network | None:
        """A fifth of the groups (of the rows, without groups) is held out for calibration and the threshold, which is the
        largest that keeps `recall` of the held-out secrets. None without both labels on both sides."""
        held = (np.arange(len(y)) if group is None else group) % 5 == 4
        if any(len(np.unique(y[s])) < 2 for s in (held, ~held)):
            return None
        net, rng = Network.start(seed=seed), np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
        turn, own_x, own_y = 0, x[~held], y[~held].astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(own_x))
            for i in range(0, len(order), 128):
                turn += 1
                some = order[i : i + 128]
                for k, g in net._gradients(own_x[some], own_y[some]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    net.weights[k] -= (0.004 * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
        z, t = net.logits(x[held]).astype(float), y[held].astype(float)
        for _ in range(200):  # logistic calibration, with a pull towards slope 1
            p = 1 / (1 + np.exp(-np.clip(net.slope * z + net.shift, -40, 40)))
            net.slope -= 0.05 * (((p - t) * z).mean() + 0.01 * (net.slope - 1))
            net.shift -= 0.05 * (p - t).mean()
        good = np.sort(net.probability(x[held][t == 1]))
        net.threshold = float(good[int((1 - recall) * len(good))])
        return net


def _examples(text: str, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """Windows of at most `most` findings, evenly chosen, and of about as many other tokens, with their labels.

    A secret must also be known without what introduces it, and when it is shorter: whole and cut to SHORT characters
    or more it stands once more where another token of the text stood.
    """
    base = base_spans(text)
    others = [m.span() for m in OTHER_TOKEN.finditer(text) if not any(b.start < m.end() and m.start() < b.end for b in base)]
    for i, s in enumerate(base[:: -(-len(base) // most) or 1]):
        own = text[s.body : s.body_end]
        for x in windows(text, s.body, s.body_end)[:most]:
            yield x, 1
        a, b = others[7 * i % len(others)] if others else (0, len(text))
        left, right = text[max(0, a - LEFT) : a], text[b : b + RIGHT]
        for size in (len(own), min(len(own), SHORT + zlib.crc32(own.encode()) % max(1, len(own) - SHORT))):
            yield windows(left + own[:size] + right, len(left), len(left) + size)[0], 1
    odd = [s for s in others if any(c.isdigit() for c in text[s[0] : s[1]])]
    for a, b in odd[:most] + others[:: max(1, len(others) // 6)]:
        yield windows(text, a, b)[0], 0
    for s in other_candidates(text, base)[:most]:  # as scan() cuts them
        yield windows(text, s.body, s.body_end)[0], 0


def fit_network(docs: DataFrame, sample: int = 3000, recall: float = 0.98, most: int = 20) -> Network | None:
    """The network from at most `sample` documents with findings (smallest hashes of the text) and `most` findings of each; None if there are too few."""
    look = F.col("text").rlike("|".join(f"(?:{LOOK[k]})" for k in KINDS))
    some = docs.where("text IS NOT NULL").where(look).select("text", F.xxhash64("text").alias("h"))
    chosen = some.select("h").distinct().orderBy("h").limit(sample)
    texts = some.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("text", "h")  # at most `sample` keys

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, x, y = [], [], []
        for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for a, b in _examples(text, most):
                h.append(key)
                x.append(a.tobytes())
                y.append(b)
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.int32())], ["h", "x", "y"])

    got = map_chunks(texts, run, "h long, x binary, y int").toArrow().sort_by([("h", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.int16).reshape(-1, WIDTH)
    return Network.fit(x, got["y"].to_numpy(), recall, group=got["h"].to_numpy())


FOUND = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, sample: int = 3000, recall: float = 0.98) -> DataFrame:
    """doc_id, found: one row for each row of docs; found by start, then kind as listed ("cnn" last).

    docs: doc_id, text; more columns are ignored. Places are code points, end exclusive. A null text is empty.
    Repeated rows give the same findings; a null doc_id stays null. score is the network's calibrated chance, null
    where the sample held too few findings to train one; then no spans are added.
    """
    network = docs.sparkSession.sparkContext.broadcast(fit_network(docs, sample, recall))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = network.value
        text = batch.column(1).fill_null("")
        looks = [pc.match_substring_regex(text, LOOK[k]).to_numpy(zero_copy_only=False) for k in (*KINDS, "cnn")]
        found: list[list] = [[] for _ in range(batch.num_rows)]
        spans, x, row, first = [], [], [], []
        for i in np.flatnonzero(np.any(looks, axis=0)):
            body = text[int(i)].as_py()
            base = base_spans(body, tuple(bool(c[i]) for c in looks[:3]))
            for s in base + (other_candidates(body, base) if net and looks[3][i] else []):
                spans.append(s)
                row.append(i)
                if net:
                    first.append(len(x))
                    x += windows(body, s.body, s.body_end)
        score = np.maximum.reduceat(net.probability(np.array(x)), first).tolist() if x else [None] * len(spans)
        for s, i, p in zip(spans, row, score):
            if s.kind != "cnn" or p >= net.threshold:
                found[i].append((s.start, [*KINDS, "cnn"].index(s.kind), {"kind": s.kind, "start": s.start, "end": s.end, "score": p}))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([[f[2] for f in sorted(own, key=lambda f: f[:2])] for own in found], _FOUND)], ["doc_id", "found"])

    return map_chunks(docs.select("doc_id", "text"), run, f"doc_id {kind}, found {FOUND}")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, scores (as text, in the order of spans, two digits) of scan()'s rows."""
    text = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"] != "cnn")
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), F.array_join(F.transform("found", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind
