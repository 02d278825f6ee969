"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as a linked list of its bytes.  A heap holds the ranks of its adjacent pairs; the pair of
lowest rank, the leftmost of equals, is popped and merged until none is left.  The count is the
number of bytes less the number of merges, and no identifiers are produced.

The vocabulary is a ``tokenizers`` file of a byte-level BPE model without normaliser.  Its added
tokens are cut out of the text first and count one each, as the library does by default.  Each Python
worker remembers the counts of the pre-tokens it has met, up to a fixed number.

A null text counts as empty: no bytes, no tokens.  Every input row gives one row, whatever its
``doc_id``.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: White space and pre-token pattern of byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
             rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
ASCII_PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
                   r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: Pre-tokens a worker remembers before it starts afresh.
REMEMBERED = 400_000
_SHIFT = 20
_PLACE = (1 << 40) - 1


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class MergeCounter(dict):
    """Pre-token -> number of tokens, worked out on first use."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        steps = model["pre_tokenizer"] or {}
        if (model["model"]["type"], steps.get("type"), model["normalizer"]) != ("BPE", "ByteLevel", None) or (
                steps.get("add_prefix_space") or model["model"].get("ignore_merges")):
            raise ValueError(f"{path} is not a plain byte-level BPE model")
        added = [t for t in model.get("added_tokens") or []]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        vocab = model["model"]["vocab"]
        letters = _byte_letters()
        self.start = [vocab[letters[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] << _SHIFT | vocab[right], rank)
            self.merged.append(vocab[left + right])
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.wide = regex.compile(PRE_TOKEN).findall
        self.narrow = re.compile(ASCII_PRE_TOKEN).findall

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = n = self.merge(token.encode())
        return n

    def merge(self, token: bytes) -> int:
        """Symbols left when no adjacent pair can be merged any more."""
        rank_of, merged = self.rank.get, self.merged
        at = [*map(self.start.__getitem__, token)]
        ranks = [rank_of(a << _SHIFT | b) for a, b in zip(at, at[1:])]      # of the pair that starts here
        heap = [r << 40 | i for i, r in enumerate(ranks) if r is not None]
        count = n = len(at)
        if not heap:
            return n
        heapify(heap)
        ranks.append(None)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while heap:
            e = heappop(heap)
            r, i = e >> 40, e & _PLACE
            if ranks[i] != r:
                continue        # one of the two has been merged since
            j = after[i]
            new = at[i] = merged[r]
            ranks[j] = None
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = ranks[i] = rank_of(new << _SHIFT | at[k])
                if r is not None:
                    heappush(heap, r << 40 | i)
            else:
                ranks[i] = None
            k = before[i]
            if k >= 0:
                r = ranks[k] = rank_of(at[k] << _SHIFT | new)
                if r is not None:
                    heappush(heap, r << 40 | k)
        return count

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            total = len(parts) - 1
        for part in parts:
            total += sum(map(self.__getitem__, (self.narrow if part.isascii() else self.wide)(part)))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """UTF-8 bytes and tokens of every text, and whether there are more than ``limit`` tokens.

    ``vocabulary`` is the path of the tokenizer file, the same on every machine.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for part in (p for b in batches for p in slices(b)):
            texts = [t or "" for t in part.column("text").to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
