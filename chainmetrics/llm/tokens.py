"""Token counts by rank-synchronous merging of byte-pair sequences.

Distinct pre-tokens of a batch lie end to end in numpy arrays, one ragged row each. Each round finds the lowest
merge rank of every row and applies that pair at once wherever it occurs in the row; rows without a pair are
done, and their surviving symbols are their tokens.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_chunks

#: The pre-tokenizer pattern of byte-level BPE, white space as Unicode's White_Space property.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Counts that a worker keeps; beyond, it starts anew.
KEPT = 300_000
NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Merges:
    """Merge ranks of a byte-level BPE file, as sorted pair keys; with a suffix for word ends, if the file has one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.last = np.array([vocab[s + suffix] for s in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.counts: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each of the non-empty pieces, and their ids end to end."""
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.first[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        row = np.repeat(np.arange(len(pieces)), size)
        out, done = size.copy(), []

        def pair_ranks(i: np.ndarray) -> np.ndarray:
            """Rank of the pair from each index on; NONE at a row's end."""
            n = len(sym)
            j = np.minimum(i + 1, n - 1)
            got = self.ranks(sym[i], sym[j])
            got[(i + 1 >= n) | (row[i] != row[j])] = NONE
            return got

        rank = pair_ranks(np.arange(len(sym)))
        while len(sym):
            heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            lowest = np.minimum.reduceat(rank, heads)
            length = np.diff(np.concatenate((heads, [len(sym)])))
            out[row[heads]] = length
            spread = np.repeat(lowest, length)
            live = spread < NONE
            if not live.all():
                done.append((row[~live], sym[~live]))
                sym, row, rank, spread = sym[live], row[live], rank[live], spread[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == spread)
            # of pairs that overlap (a run like "aaa") every second one, from the left
            run = np.concatenate(([True], np.diff(hit) != 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, row, rank = sym[keep], row[keep], rank[keep]
            at = moved[hit]
            near = np.zeros(len(sym) + 1, bool)
            near[at] = near[at - 1] = True  # before the first pair: the spare place at the end
            again = np.flatnonzero(near[:-1])
            rank[again] = pair_ranks(again)
        rows, ids = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        return out, ids[np.argsort(rows, kind="stable")]

    def count(self, texts: list[str]) -> list[int]:
        parts = []
        for text in texts:
            pieces = [text]
            for s in self.special:
                pieces = [q for p in pieces for q in p.split(s)]
            parts.append((len(pieces) - 1, [t for p in pieces for t in PRE_TOKENS.findall(p)]))
        if len(self.counts) > KEPT:
            self.counts.clear()
        new = list({t for _, own in parts for t in own}.difference(self.counts))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            self.counts.update(zip(some, self.merged([t.encode() for t in some])[0].tolist()))
        get = self.counts.__getitem__
        return [extra + sum(map(get, own)) for extra, own in parts]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs.

    docs: doc_id, text; more columns are ignored. path: a byte-level BPE file that every worker can read. A null
    text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are one token each; none are added.
    Repeated rows are counted each; a null doc_id stays null.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        size = [len(t.encode()) for t in texts]
        n = merges(path).count(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_chunks(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
