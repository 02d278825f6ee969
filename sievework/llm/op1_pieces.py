"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is escaped and cut into marked words: a run of marks and what follows up to the next mark; no
piece crosses such a cut.  The distinct words of a batch are sorted, which walks their trie depth-first:
the forward states of a word are those of the word before up to the common prefix, and only the
rest is worked out.

The state of a prefix is the best piece that ends it.  For a unigram vocabulary that is the piece with
the best sum of scores.  In a byte-pair vocabulary sums of scores mean nothing, the library
merges by rank instead.  There the path into a prefix is restricted to neighbours that the
merges leave apart; exactly one piece passes, and the result is that of the merges.

Null and empty texts give no identifiers and decode to an empty text.  Every input row gives one
row.  Characters outside the vocabulary become byte pieces.  A mark character in a text decodes to a blank,
as in the library.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

MARK = "▁"
#: Words and neighbouring pieces a worker remembers before it starts afresh.
REMEMBERED_WORDS = 700_000
REMEMBERED_PAIRS = 500_000
#: Fixed value: how far below the least score an unknown character stands.
UNKNOWN_PENALTY = 10.0



class Pieces:
    """Encoder and decoder for one vocabulary: lists of pieces and scores, identifiers being places."""

    def __init__(self, pieces: list[str], scores: list[float], unknown: int, byte_ids: list[int] | None,
                 usable: list[bool], kind: str = "bpe"):
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind {kind!r}")
        self.ids = {p: i for i, p in enumerate(pieces) if usable[i]}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces that go on over a mark are not supported")
        self.pieces, self.scores, self.unknown, self.byte_ids, self.kind = pieces, scores, unknown, byte_ids, kind
        loose = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))      # part of no piece: cut there as well
        self.words = re.compile(f"{MARK}*[^{MARK}{loose}]+|{MARK}+" + (f"|[{loose}]+" if loose else ""))
        self.inner = {p[i:] for p in self.ids for i in range(1, len(p))}      # what a longer piece ends with
        self.rank = {i: -scores[i] if len(p) > 1 else -1.0 for p, i in self.ids.items()}      # when it is merged
        self.halves: dict[int, tuple[int, int]] = {}
        self.floor = min((scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.bytes = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids or []):
            self.bytes[i] = bytes([b])
        self.table = np.array(self.bytes, object)

    def _merged(self, text: str, left: int = 1) -> list[str]:
        """The merges on a short text, highest score first, leftmost of equals, until ``left`` parts are left."""
        parts = list(text)
        while len(parts) > left:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _half(self, k: int, side: int) -> int:
        halves = self.halves.get(k)
        if halves is None:
            halves = self.halves[k] = tuple(map(self.ids.__getitem__, self._merged(self.pieces[k], 2)))
        return halves[side]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave two neighbouring pieces as they are.

        Taken back from the latest merge on: no pair that ever stands at the border may come first.
        """
        pieces, rank = self.pieces, self.rank
        if MARK + MARK in pieces[left] + pieces[right]:      # runs of marks all have one score
            return self._merged(pieces[left] + pieces[right]) == [pieces[left], pieces[right]]
        limit, same = float("inf"), True
        while True:
            pair = self.ids.get(pieces[left] + pieces[right])
            if pair is not None and (rank[pair] < limit or same and rank[pair] == limit):
                return False
            if rank[left] > rank[right]:
                limit, same, left = rank[left], False, self._half(left, 1)
            elif rank[right] < 0:
                return True
            else:
                limit, same, right = rank[right], True, self._half(right, 0)

    def encode_words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Identifiers of distinct marked words, by one depth-first walk of their trie."""
        get, inner, apart, found, last = self.ids.get, self.inner, self.apart, {}, ""
        by_merges, scores, floor = self.kind == "bpe", self.scores, self.floor
        start, piece, score = [0], [-1], [0.0]        # forward state at the end of each prefix
        for word in sorted(words):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del start[shared + 1:], piece[shared + 1:], score[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                at, best, value = end - 1, -1, 0.0
                options, j = [], end - 1
                part = word[j:end]
                while True:
                    k = get(part)
                    if k is not None:
                        options.append((j, k))
                    if j == 0 or part not in inner:
                        break
                    j -= 1
                    part = word[j:end]
                if by_merges:
                    for j, k in reversed(options):
                        left = piece[j]
                        if left >= 0:
                            ok = apart.get(left << 32 | k)
                            if ok is None:
                                if len(apart) >= REMEMBERED_PAIRS:
                                    apart.clear()
                                ok = apart[left << 32 | k] = self._stay_apart(left, k)
                            if not ok:
                                continue
                        at, best = j, k
                        break
                else:
                    if not options or options[0][0] < end - 1:
                        options.insert(0, (end - 1, -1))
                    value = None
                    for j, k in reversed(options):
                        here = score[j] + (floor if k < 0 else scores[k])
                        if value is None or here > value:
                            at, best, value = j, k, here
                start.append(at)
                piece.append(best)
                score.append(value)
            path, end = [], len(word)
            while end:
                k = piece[end]
                if k < 0:
                    path += self._unknown(word[start[end]:end])
                else:
                    path.append(k)
                end = start[end]
            found[word] = tuple(path[::-1])
            last = word
        return found

    def _unknown(self, part: str) -> list[int]:
        """Identifiers of a character outside the vocabulary, last first."""
        return [self.byte_ids[b] for b in reversed(part.encode())] if self.byte_ids else [self.unknown]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts one after another, and how many each text has."""
        split = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set(chain.from_iterable(split)) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.known = {}
            new = set(chain.from_iterable(split))
        for word, ids in self.encode_words(new).items():
            self.known[word] = array("i", ids).tobytes()
        parts = [b"".join(map(self.known.__getitem__, words)) for words in split]
        return np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts], np.int64)

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of identifiers that stand one after another, less the blank put in front."""
        pieces, ends, out = self.table[ids].tolist(), np.cumsum(counts).tolist(), []
        for start, end in zip([0, *ends], ends):
            text = b"".join(pieces[start:end]).decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, counts = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64), np.array([len(ids)]))[0]


@lru_cache(maxsize=2)
def load(path: str, kind: str = "bpe") -> Pieces:
    """Vocabulary of a model file whose normaliser only escapes blanks and puts one in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "  a Åﬁ  "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError(f"{path} changes texts before it encodes them")
    n = range(model.get_piece_size())
    byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in n if model.is_byte(i)}
    usable = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in n]
    return Pieces([model.id_to_piece(i) for i in n], [model.get_score(i) for i in n], model.unk_id(),
                  [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None, usable, kind)


def encode(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """doc_id, ids (array of int) and the text they decode to, for every row.

    ``model`` is the path of the model file, the same on every machine.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model, kind)
        for part in (p for b in batches for p in slices(b)):
            ids, counts = pieces.encode_flat([t or "" for t in part.column("text").to_pylist()])
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(ids)),
                 pa.array(pieces.decode_flat(ids, counts), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, model: str, kind: str = "bpe", ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its identifiers, null where they are null."""
    @F.pandas_udf("string")
    def text_of(column):
        pieces = load(model, kind)
        return column.map(lambda x: None if x is None else pieces.decode(x))

    return encoded.withColumn("decoded", text_of(F.col(ids)))


def encoded_digest(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """Identifiers of every text, their number, and the digest of the text they decode to."""
    return encode(docs, model, kind).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
