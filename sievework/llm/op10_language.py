"""Language identification by string kernels.

Two texts are as similar as the character n-grams of one to three characters that occur in both, presence only, over the
geometric mean of their numbers (blended spectrum).  A Nyström map over landmark texts turns the kernel
into a vector space, where one ridge regression per language against the rest is fitted.  Both together are one
weight for each n-gram of the landmarks and each language, so a text is scored by a sum over its n-grams.  N-grams
are told apart by 32 bits and kept as sorted lists, however long a text is.

The model is fitted on a sample: SAMPLE texts, as many of each language and one at least, chosen by a hash of
``doc_id``, one row of each; LANDMARKS of them are landmarks, or one of each language if there are more languages.
All languages can be predicted.  Everything else covers every row.

A null text or one without a letter is ``und`` with score 0, as is any text when nothing could be learned.
Rows with a null ``doc_id`` or language are scored and not learned from.  Repeated rows give equal results.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import slices

SAMPLE, LANDMARKS = 1024, 256
#: The longest n-gram.
LONGEST = 3
RIDGE = 0.1
UNKNOWN = "und"
_ROWS = 256


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct n-grams of each text, in order, over whole texts in lower case."""
    points = [np.frombuffer(t.lower().encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    chars = np.concatenate(points).astype(np.uint64) if points else np.zeros(0, np.uint64)
    rows, ends = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes), np.repeat(np.cumsum(sizes), sizes)
    found, gram = [], np.zeros(len(chars), np.uint64)
    for n in range(1, LONGEST + 1):
        gram = gram[:max(0, len(chars) - n + 1)] * np.uint64(0x100000001B3) + chars[n - 1:] + np.uint64(n)
        inside = np.arange(len(gram)) + n <= ends[:len(gram)]
        # the multiplication leaves the best bits on top
        short = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        found.append(_distinct(((rows[:len(gram)] << np.uint64(32)) | short)[inside]))
    keys = _distinct(np.concatenate(found))
    return (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def presence(texts: list[str]) -> np.ndarray:
    """Which of the n-grams of all these texts occur in each, as a plain matrix."""
    rows, hashes = grams(texts)
    known, at = np.unique(hashes, return_inverse=True)
    seen = np.zeros((len(texts), len(known)), bool)
    seen[rows, at] = True
    return seen


def kernel(seen: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised number of common n-grams of every text with every landmark, from plain matrices."""
    both = seen.astype(np.float32) @ landmarks.T
    return both / np.sqrt(np.maximum(seen.sum(1), 1))[:, None] / np.sqrt(np.maximum(landmarks.sum(1), 1))[None, :]


def kernel_of(texts: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """The kernel from sorted lists of hashes, none of a landmark empty."""
    known = np.unique(np.concatenate(landmarks))
    of_landmarks = np.searchsorted(known, np.concatenate(landmarks))
    sizes = np.array([len(x) for x in landmarks])
    starts, out = np.cumsum(sizes) - sizes, np.zeros((len(texts), len(landmarks)))
    for i, text in enumerate(texts):
        mask = np.isin(known, text, assume_unique=True)
        out[i] = np.add.reduceat(mask[of_landmarks], starts, dtype=np.int64) / np.sqrt(max(len(text), 1) * sizes)
    return out


def fit(texts: list[np.ndarray], languages: list[str], n_landmarks: int = LANDMARKS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, the n-grams of the landmarks in order and the weight of each of them for each language."""
    names = sorted(set(languages))
    own = np.searchsorted(np.array(names, object), np.array(languages, object))
    turn = np.zeros(len(own), np.int64)
    for k in range(len(names)):
        turn[own == k] = np.arange((own == k).sum())
    landmarks = [texts[i] for i in np.lexsort((own, turn))[:max(n_landmarks, len(names))]]
    values, vectors = np.linalg.eigh(kernel_of(landmarks, landmarks))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = kernel_of(texts, landmarks) @ root
    target = np.where(own[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    weights = 1.0 / np.bincount(own)[own]
    left = mapped.T @ (mapped * weights[:, None]) + RIDGE / len(own) * np.eye(mapped.shape[1])
    matrix = root @ np.linalg.solve(left, mapped.T @ (target * weights[:, None]))
    known = np.unique(np.concatenate(landmarks))
    per_gram = np.zeros((len(known), len(names)), np.float32)
    for landmark, row in zip(landmarks, matrix):
        per_gram[np.searchsorted(known, landmark)] += (row / np.sqrt(len(landmark))).astype(np.float32)
    return names, known, per_gram


def scores(texts: list[str], known: np.ndarray, per_gram: np.ndarray) -> np.ndarray:
    """One value a language for every text."""
    rows, hashes = grams(texts)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    out, size = np.zeros((len(texts), per_gram.shape[1])), np.bincount(rows, minlength=len(texts))
    some, starts = np.unique(rows[hit], return_index=True)
    if len(some):
        out[some] = np.add.reduceat(per_gram[at[hit]], starts, axis=0, dtype=np.float64)
    return out / np.sqrt(np.maximum(size, 1))[:, None]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """The model of the sample; null when no text can be learned from."""
    labelled = docs.where(~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    n = labelled.select("lang").distinct().count()
    if not n:
        return None
    labelled = labelled.where(F.col("text").rlike("\\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # dealt by identifier, so that every task keeps its first of a frequent language before they meet
    picked = labelled.select("doc_id", "lang").distinct().repartition("lang", "doc_id").withColumn("k", F.row_number().over(order)).where(
        F.col("k") <= max(1, SAMPLE // n)).select("doc_id", "lang").collect()
    ids = list({r["doc_id"] for r in picked})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in _parts(b)):
            rows, hashes = grams([t or "" for t in part.column("text").to_pylist()])
            cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(
                [hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "lang", "grams"])

    # copies of a sampled row are one before they meet; of several texts under one identifier and language one is taken
    chosen = {(r["doc_id"], r["lang"]) for r in picked}
    one = labelled.where(F.col("doc_id").isin(ids)).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = [r for r in one.mapInArrow(listed, "doc_id long, lang string, grams binary").collect() if (r["doc_id"], r["lang"]) in chosen]
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["grams"])))
    return fit([np.frombuffer(r["grams"], np.uint32) for r in rows], [r["lang"] for r in rows])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch):
        for at in range(0, part.num_rows, _ROWS):
            yield part.slice(at, _ROWS)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    model = learn(lean)
    names, known, per_gram = model or ([], np.zeros(0, np.uint32), np.zeros((0, 0), np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in _parts(b)):
            texts = [t or "" for t in part.column("text").to_pylist()]
            found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if names and any(map(str.isalpha, t))]
            if some:
                values = scores([texts[i] for i in some], known, per_gram)
                for i, k, best in zip(some, values.argmax(1), values.max(1)):
                    found[i], score[i] = names[k], min(1.0, max(0.0, (best + 1) / 2))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    return lean.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
