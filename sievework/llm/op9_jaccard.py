"""N-gram Jaccard self join by token-combination prefixes.

A document's tokens are its distinct word shingles.  Tokens are ordered, rare ones first, and a prefix is
taken that is long enough for any two linked documents to share a signature of it.  Rare tokens are
signatures on their own.  Frequent tokens fall into subclasses, and a signature is a pair of tokens
of one subclass; a subclass of m prefix tokens then survives all but m - 1 missing ones.  A
prefix is extended until the tokens a linked document may lack cannot cover all signatures, so no link is
lost.  Documents of different size classes have their own number of subclasses, and sizes near a
border take part on both sides.  Which tokens are frequent is read from counts of 262,144 hash buckets over
the whole table; it only steers the cost, never the result.

Documents with equal token sets are one class and its smallest ``doc_id`` stands for them.  Up to eight documents
that share a signature are compared pair by pair, first by sketches that bound the overlap from above, then by their
texts.  Members of larger groups are laid out in blocks, by the smallest document they share a signature with
and by size.  Two blocks that share a signature meet in one task if their sizes allow a link, and all overlaps come
from one matrix product.  Such a task hands on a spanning forest of its links, so neither pairs nor links of a
large group are ever listed.

Null texts and texts without words have no token and link with nothing.  Rows with a null ``doc_id`` are
left alone, their component is null.  Repeated rows give their result each; texts under one ``doc_id``
are one document that links by any of them.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .sides import narrow
from .words import Words, _mix, slices

BUCKETS = 1 << 18
_CHUNK = 1024
#: A bucket is frequent at this many standard deviations above the mean of evenly spread tokens, and from this count on.
FREQUENT_DEVIATIONS, FREQUENT_LEAST = 8, 32
#: Largest token set of the first size class, and the ratio of each class to the one before.
FIRST_SIZE, SIZE_RATIO = 20, 5
#: Documents under one signature up to which their pairs are listed, 28 at most; more are compared block by block.
SMALL_GROUP = 8
BLOCK = 512
_COLUMNS = 4096

_U = np.uint64


def _tokens(part: pa.RecordBatch, size: int, column: str = "text") -> Iterator[np.ndarray]:
    """Sorted distinct token hashes of every row."""
    words = Words(part.column(column), lower=True)
    shingles, room = words.windows(size), words.room(size)
    whole, _ = words.digests()
    for r in range(part.num_rows):
        start, end = words.first[r], words.first[r + 1]
        if end - start >= size:
            yield np.unique(shingles[start:end][room[start:end]])
        else:
            yield whole[r:r + 1] if end > start else shingles[:0]


def _digests(tokens: np.ndarray) -> tuple[int, int]:
    return (int(_mix(tokens).sum(dtype=_U).view(np.int64)), int(_mix(tokens ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)))


def _sketch(tokens: np.ndarray) -> bytes:
    """Tokens of the set in each bucket, four a bucket in sets of up to 16,384; 255 stands for that many or more."""
    buckets = min(max(64, 1 << (len(tokens) // 4).bit_length()), 4096)
    return np.minimum(np.bincount((tokens & _U(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def _overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """At least the number of common tokens of two sets, from their sketches."""
    if x.max() == 255 or y.max() == 255:
        return np.iinfo(np.int64).max // 1000
    if len(x) != len(y):
        short = min(len(x), len(y))
        x, y = (v.reshape(-1, short).sum(0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum(dtype=np.int64))


def _shapes(size: int):
    """Size, digest and sketch of every token set; at the end of a task, its counts of buckets."""
    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())])],
            ["doc_id", "n_shingles", "d1", "d2", "sketch", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for part in (p for b in batches for p in slices(b)):
            rows = []
            for doc, tokens in zip(part.column("doc_id").to_pylist(), _tokens(part, size)):
                np.add.at(counts, (tokens >> _U(46)).astype(np.int64), 1)
                rows.append((doc, len(tokens), *_digests(tokens), _sketch(tokens), None))
            if rows:
                yield batch(rows)
        if counts.any():
            yield batch([(None, -1 - k, None, None, None, counts[k * _CHUNK:(k + 1) * _CHUNK].tolist())
                         for k in range(BUCKETS // _CHUNK)])
    return run


def _signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a token set under every size class it takes part in."""
    n = len(tokens)
    may_lack = n - -(-percent * n // 100)
    is_frequent = frequent[(tokens >> _U(46)).astype(np.int64)]
    rare, common = tokens[~is_frequent], tokens[is_frequent]
    out, below, upto, scheme = [], 0, FIRST_SIZE, 0
    while 100 * n >= percent * below:
        if n <= upto:
            salt = _U(scheme + 1)
            need = may_lack + 1
            if scheme == 0:
                picked, rest = np.concatenate([rare, common])[:need], common[:0]
            else:
                picked, rest = rare[:need], common
            out.append(_mix(picked + salt))
            need -= len(picked)
            if need > 0 and len(rest):
                out.append(_pairs(rest, need, max(1, below * percent * percent // 20000), salt))
        below, upto, scheme = upto, upto * SIZE_RATIO, scheme + 1
    return np.unique(np.concatenate(out)) if out else tokens[:0]


def _pairs(tokens: np.ndarray, need: int, subclasses: int, salt: np.uint64) -> np.ndarray:
    """Pairs within subclasses of the shortest prefix that survives ``need - 1`` missing tokens."""
    kind = ((tokens >> _U(8)) % _U(subclasses)).astype(np.int64)
    again = np.ones(len(tokens), bool)
    again[np.unique(kind, return_index=True)[1]] = False
    stop = int(np.searchsorted(np.cumsum(again), need)) + 1
    order = np.argsort(kind[:stop], kind="stable")
    kind, tokens = kind[order], tokens[order]
    out, lag = [], 1
    while True:
        same = kind[:-lag] == kind[lag:] if lag < len(kind) else np.zeros(0, bool)
        if not same.any():
            return np.concatenate(out) if out else tokens[:0]
        out.append(_mix(_mix(tokens[:-lag][same] + salt) + tokens[lag:][same]))
        lag += 1


def _signed(size: int, percent: int, frequent: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(frequent, np.uint8)).astype(bool)
        for part in (p for b in batches for p in slices(b)):
            docs, lengths, firsts, seconds, signs = [], [], [], [], []
            for doc, tokens in zip(part.column("doc_id").to_pylist(), _tokens(part, size)):
                if len(tokens):
                    d1, d2 = _digests(tokens)
                    docs.append(doc), lengths.append(len(tokens)), firsts.append(d1), seconds.append(d2)
                    signs.append(_signatures(tokens, flags, percent).view(np.int64))
            if docs:
                flat = pa.array(np.concatenate(signs))
                at = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in signs])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(lengths, pa.int64()), pa.array(firsts, pa.int64()),
                     pa.array(seconds, pa.int64()), pa.ListArray.from_arrays(at, flat)],
                    ["doc_id", "n_shingles", "d1", "d2", "signatures"])
    return run


def _may_link(percent: int):
    """Pairs whose sketches allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x, y = ([np.frombuffer(v, np.uint8) for v in part.column(c).to_pylist()] for c in ("sketch_a", "sketch_b"))
            most = np.array([_overlap_bound(*xy) for xy in zip(x, y)], np.int64)
            sizes = part.column("size_a").to_numpy() + part.column("size_b").to_numpy()
            yield part.select(["a", "b"]).filter(pa.array(100 * most >= percent * (sizes - most)))
    return run


def _hopeful(percent: int):
    """Documents of a visit whose sketch allows a link with one of the other side."""
    def run(visit: pa.Table) -> pa.Table:
        sketches = [np.frombuffer(v, np.uint8) for v in visit.column("sketch").to_pylist()]
        sizes, side = visit.column("n_shingles").to_pylist(), visit.column("side").to_pylist()
        left, right = ([k for k, s in enumerate(side) if s == want] for want in (True, False))
        keep = np.zeros(len(sizes), bool)
        for x in left:
            for y in right:
                if not (keep[x] and keep[y]) and 100 * min(sizes[x], sizes[y]) >= percent * max(sizes[x], sizes[y]):
                    most = _overlap_bound(sketches[x], sketches[y])
                    if 100 * most >= percent * (sizes[x] + sizes[y] - most):
                        keep[x] = keep[y] = True
        return visit.select(["i", "j", "doc_id"]).filter(pa.array(keep))
    return run


def _linked(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text_a")):
            keep = []
            for at in (p for p in slices(part, "text_b")):
                keep += [100 * (both := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - both)
                         for x, y in zip(_tokens(at, size, "text_a"), _tokens(at, size, "text_b"))]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _within(size: int, percent: int):
    """Enough links to connect what is linked among the documents of one visit."""
    def run(visit: pa.Table) -> pa.Table:
        docs = visit.column("doc_id").to_numpy()
        sets = [t for part in visit.combine_chunks().to_batches() for p in slices(part) for t in _tokens(p, size)]
        lengths = np.array([len(t) for t in sets])
        _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), lengths)
        rows, ids = rows[times[ids] > 1], ids[times[ids] > 1]
        order = np.argsort(ids, kind="stable")
        rows, ids = rows[order], np.unique(ids[order], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, _COLUMNS):
            lo, hi = np.searchsorted(ids, [at, at + _COLUMNS])
            held = np.zeros((len(sets), _COLUMNS), np.float32)
            held[rows[lo:hi], ids[lo:hi] - at] = 1
            both += held @ held.T
        both = both.astype(np.int64)
        linked = 100 * both >= percent * (lengths[:, None] + lengths[None, :] - both)
        waiting, a, b = np.ones(len(sets), bool), [], []
        for root in range(len(sets)):
            if not waiting[root]:
                continue
            waiting[root], open_ = False, [root]
            while open_:
                node = open_.pop()
                new = np.flatnonzero(linked[node] & waiting)
                waiting[new] = False
                a += [docs[node]] * len(new)
                b += docs[new].tolist()
                open_ += new.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _meetings(members: DataFrame, placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What meets under large signatures: blocks of one home whole, of others only documents that share one.

    Either way only where the sizes allow a link; whole blocks are (i, j, doc_id), the others have sizes and sides besides.
    """
    at = F.struct("home", "block").alias("at")
    held = members.join(placed.drop("n_shingles"), "doc_id").select("signature", "doc_id", "n_shingles", at)
    ranges = held.groupBy("signature", "at").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    inside = ranges.alias("x").join(ranges.alias("y"), F.expr(
        "x.signature = y.signature AND x.at.home = y.at.home AND x.at.block <= y.at.block "
        f"AND {percent} * x.lo <= 100 * y.hi AND {percent} * y.lo <= 100 * x.hi")).select(
        F.col("x.at").alias("i"), F.col("y.at").alias("j")).distinct()
    whole = placed.select("doc_id", at).join(
        inside.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("at")), "at").select("i", "j", "doc_id")
    across = held.alias("x").join(ranges.alias("y"), F.expr(
        "x.signature = y.signature AND x.at.home <> y.at.home "
        f"AND {percent} * x.n_shingles <= 100 * y.hi AND {percent} * y.lo <= 100 * x.n_shingles")).select(
        F.least("x.at", "y.at").alias("i"), F.greatest("x.at", "y.at").alias("j"), F.col("x.doc_id").alias("doc_id"),
        F.col("x.n_shingles").alias("n_shingles"), (F.col("x.at") < F.col("y.at")).alias("side")).distinct()
    return whole, materialize(across, "across-homes")


def _all_links(members: DataFrame, shapes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Enough links between class representatives to give all components.

    ``members`` has signature, doc_id and n_shingles for signatures of two documents at least.
    """
    counts = members.groupBy("signature").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub"))
    large = materialize(members.join(counts.where(F.col("n") > SMALL_GROUP).select("signature", "hub"), "signature"), "large-groups")
    homes = large.groupBy("doc_id", "n_shingles").agg(F.min("hub").alias("home"))
    before = Window.partitionBy("home").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    spread = homes.groupBy("home", "n_shingles").agg(F.count("*").alias("c")).withColumn(
        "before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    placed = materialize(homes.join(spread, ["home", "n_shingles"]).select(
        "home", "doc_id", "n_shingles", F.floor((F.col("before") + F.pmod(F.xxhash64("doc_id"), F.col("c"))) / BLOCK).alias("block")), "blocks")

    whole, across = _meetings(large, placed, percent)

    small = materialize(members.join(counts.where(F.col("n") <= SMALL_GROUP).select("signature"), "signature"), "small-groups")
    pairs = materialize(small.alias("x").join(small.alias("y"), F.expr(
        "x.signature = y.signature AND x.doc_id < y.doc_id "
        f"AND 100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles)")).select(
        F.col("x.doc_id").alias("a"), F.col("x.n_shingles").alias("size_a"), F.col("y.doc_id").alias("b"),
        F.col("y.n_shingles").alias("size_b")).distinct(), "pairs")
    doubtful = materialize(across.select("doc_id").unionByName(pairs.select(F.col("a").alias("doc_id"))).unionByName(
        pairs.select(F.col("b").alias("doc_id"))).distinct(), "doubtful")
    sketches = materialize(shapes.where("n_shingles > 0").join(narrow(doubtful), "doc_id", "left_semi").select(
        "doc_id", "n_shingles", "sketch").distinct(), "sketches")

    place = "struct<home:bigint,block:bigint>"
    across = across.join(sketches, ["doc_id", "n_shingles"]).groupBy("i", "j").applyInArrow(
        _hopeful(percent), f"i {place}, j {place}, doc_id long")
    visits = materialize(whole.unionByName(across).distinct(), "visits")
    pairs = materialize(pairs.join(sketches.toDF("a", "size_a", "sketch_a"), ["a", "size_a"])
                        .join(sketches.toDF("b", "size_b", "sketch_b"), ["b", "size_b"])
                        .select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_may_link(percent), "a long, b long")
                        .distinct(), "hopeful-pairs")
    texts = texts.select("doc_id", "text")
    found = (texts.toDF("a", "text_a").join(narrow(pairs), "a")
             .join(texts.toDF("b", "text_b").join(narrow(pairs.select("b").distinct()), "b", "left_semi"), "b")
             .select("a", "b", "text_a", "text_b").mapInArrow(_linked(size, percent), "a long, b long"))
    met = texts.join(narrow(visits), "doc_id").select("i", "j", "doc_id", "text").groupBy("i", "j").applyInArrow(
        _within(size, percent), "a long, b long")
    return found.unionByName(met)


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for every row.

    Two documents link when their distinct shingles of ``size`` lower-cased words have a Jaccard
    similarity of at least ``percent`` hundredths; a text of fewer words is one shingle.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialize(texts.mapInArrow(
        _shapes(size), "doc_id long, n_shingles long, d1 long, d2 long, sketch binary, counts array<long>"), "shapes")
    shapes = table.where("n_shingles >= 0").drop("counts")
    counts = table.where("n_shingles < 0").select("n_shingles", F.posexplode("counts").alias("place", "c")).groupBy(
        "n_shingles", "place").agg(F.sum("c").alias("c"))
    mean = (counts.agg(F.sum("c")).first()[0] or 0) / BUCKETS
    flags = np.zeros(BUCKETS, bool)      # 32 KB for any input
    for r in counts.where(F.col("c") >= max(FREQUENT_LEAST, mean + FREQUENT_DEVIATIONS * mean ** 0.5)).collect():
        flags[(-1 - r["n_shingles"]) * _CHUNK + r["place"]] = True

    classes = shapes.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    signed = texts.where("doc_id IS NOT NULL").mapInArrow(
        _signed(size, percent, np.packbits(flags).tobytes()),
        "doc_id long, n_shingles long, d1 long, d2 long, signatures array<long>")
    copies = materialize(shapes.where("n_shingles > 0 AND doc_id IS NOT NULL").join(
        classes, ["d1", "d2", "n_shingles", "doc_id"], "left_anti").select("doc_id", "d1", "d2").distinct(), "copies")
    rows = signed.join(narrow(copies), ["doc_id", "d1", "d2"], "left_anti").select(
        "doc_id", "n_shingles", F.explode("signatures").alias("signature"))
    # written, so that the join below has plain shuffles on both sides and a hot signature is split
    shared = materialize(rows.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature"), "shared")
    members = materialize(rows.join(shared, "signature", "left_semi").distinct(), "members")
    links = _all_links(members, shapes, texts, size, percent)
    known = shapes.join(classes.withColumnRenamed("doc_id", "rep"), ["d1", "d2", "n_shingles"], "left")
    parts = materialize(components(links), "components")
    return known.join(parts, known["rep"] == parts["node"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of similar documents, that of the smallest ``doc_id``, with its columns.

    Of several rows under that ``doc_id`` the one of smallest text stays.  Rows with a null ``doc_id`` all stay.
    """
    first = similar_groups(docs, size, percent).where("doc_id = component_id").select(F.col("doc_id").alias("first_")).distinct()
    named = docs.where("doc_id IS NOT NULL").join(first, F.col("doc_id").cast("long") == F.col("first_"), "left_semi")
    one = named.groupBy(F.col("doc_id").alias("doc_")).agg(
        F.min_by(F.struct(*docs.columns), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row_"))
    return one.select("row_.*").unionByName(docs.where("doc_id IS NULL"))
