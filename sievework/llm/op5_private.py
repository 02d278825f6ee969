"""Personal data by a semi-Markov conditional random field.

The base patterns give spans that always stay.  Around digits and ``@`` signs the text is cut into tokens, and every
stretch of up to LONGEST tokens is a candidate segment of each type.  Features look at a segment as a whole: its
digits, separators, checksums, borders and the word before.  The field scores segmentations of
the region, segments of at most LONGEST tokens and single tokens outside, by segment and by neighbouring types.
A forward-backward pass over segment ends gives the probability of each segment, and a Viterbi pass of
the same bounded length picks boundaries and types together.  A picked segment is added when its probability
is at least SURE and it overlaps no base span.  Candidates have as many opening as closing brackets and at most
WIDEST characters.  The passes slide over a region of any length block by block: scores are held for one block only,
and the way back for the probabilities works them out again, from forward states kept at the borders of blocks.

The weights are learned by gradient ascent on the conditional likelihood of regions whose segmentation is
known: base spans in at most SAMPLE_TEXTS texts, chosen by a hash of the text among those with
a digit or ``@``, at most SAMPLE_REGIONS of their regions.  A base span is learned also with its plus sign left out
of the features, so that the rest of its form carries weight.  Everything else covers all texts whole.

A null text counts as empty and has no span.  Every input row gives one row, repeated rows alike, whatever the
``doc_id``.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Kinds in the order they are listed, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Tokens of a segment at most, and characters of a region to each side of a digit or sign.
LONGEST, AROUND = 16, 24
#: Characters of a segment at most; ends held at a time.
WIDEST, BLOCK = 120, 2048
SAMPLE_TEXTS, SAMPLE_REGIONS, ROUNDS = 2000, 400, 12
SURE = 0.95
#: Words that announce a kind.
CUES = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "mastercard", "amex"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
}

Span = tuple[str, int, int]

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]")
_WORD, _NO_DIGIT, _OTHER = re.compile(r"[A-Za-z]+"), re.compile(r"[^0-9]+"), re.compile(r"\W|_")
_OUTSIDE = len(KINDS)


def _is_octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, sign and domain, found from the signs so that long runs cost no more."""
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            over = domain.end()
            yield "email", start, over
        at = text.find("@", max(at + 1, over))


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind as listed, then start."""
    found = list(_emails(text))
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_is_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def regions(text: str) -> Iterator[np.ndarray]:
    """Tokens of each stretch of text near digits and signs."""
    start = stop = None
    for m in _TRIGGER.finditer(text):
        if start is None:
            start, stop = m.start() - AROUND, m.end() + AROUND
        elif m.start() - AROUND <= stop:
            stop = m.end() + AROUND
        else:
            yield _tokens(text, start, stop)
            start, stop = m.start() - AROUND, m.end() + AROUND
    if start is not None:
        yield _tokens(text, start, stop)


def _tokens(text: str, start: int, stop: int) -> np.ndarray:
    """Start and stop of every token, a row each."""
    found = _TOKEN.finditer(text, max(0, start), min(len(text), stop))
    return np.fromiter((at for m in found for at in m.span()), np.int64).reshape(-1, 2)


FEATURES = 26


def features(text: str, start: int, stop: int, hide_plus: bool = False) -> np.ndarray | None:
    """What a segment looks like as a whole; null for segments no kind can take."""
    look = _look(text, start, stop, _cue(text, start), hide_plus)
    return None if look is None else np.array(look, float)


def _cue(text: str, start: int) -> str:
    """The word before a segment."""
    before = _WORD.findall(text, max(0, start - 20), start)
    return before[-1].lower() if before else ""


def _look(text: str, start: int, stop: int, cue: str, hide_plus: bool = False) -> list | None:
    if stop - start > WIDEST:
        return None
    part = text[start:stop]
    if not (part[0].isalnum() or part[0] in "+(") or not part[-1].isalnum() or part.count("(") != part.count(")"):
        return None
    digits = _NO_DIGIT.sub("", part)
    n, sign = len(digits), part.count("@")
    if not n and not sign:
        return None
    pieces, others = part.split("."), _OTHER.findall(part, 1)
    letters = any(map(str.isalpha, part))
    size = 0 if n < 7 else 1 if n < 10 else 2 if n < 12 else 3 if n < 16 else 4 if n < 20 else 5
    return [
        1, part[0] == "+" and not hide_plus, size == 0, size == 1, size == 2, size == 3, size == 4, size == 5,
        len(pieces) == 4 and all(p.isascii() and p.isdigit() and _is_octet(p) for p in pieces),
        16 <= n <= 19 and luhn(digits),
        sign == 1, sign > 1, sign == 1 and "." in part.split("@")[1], letters and not sign,
        sign > 0 and any(map(str.isspace, part)),
        len(others) >= 2 and not sign, not sign and any(c not in " ().-" for c in others),
        start > 0 and (text[start - 1].isalnum() or text[start - 1] in "@+._-") and not (hide_plus and text[start - 1] == "+"),
        stop < len(text) and (text[stop].isalnum() or text[stop] == "@"),
        not n, "  " in part, n > 0 and len(set(digits)) <= 2,
        *[cue in CUES[kind] for kind in KINDS]]


class Field:
    """Weights of segments by type and of neighbouring types; a token outside has no segment score of its own."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), FEATURES)) if weights is None else weights
        self.steps = np.zeros((len(KINDS) + 1, len(KINDS) + 1)) if steps is None else steps

    def lattice(self, text: str, tokens: list[tuple[int, int]], hide_plus: bool = False) -> list[list[tuple[int, np.ndarray]]]:
        """For each end, the starts and features of the segments that end there."""
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(len(tokens) + 1)]
        for i, (start, _) in enumerate(tokens):
            for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
                f = features(text, start, tokens[j - 1][1], hide_plus)
                if f is not None:
                    out[j].append((i, f))
        return out

    def scores(self, lattice) -> list[list[tuple[int, np.ndarray]]]:
        return [[(i, self.weights @ f) for i, f in ends] for ends in lattice]

    def forward(self, scores, best: bool = False):
        """Log sum, or maximum and its choices, over segmentations up to each end, by type of the last segment."""
        n = len(scores) - 1
        total = np.full((n + 1, len(KINDS) + 1), -np.inf)
        total[0, _OUTSIDE] = 0
        choice = {}
        for end in range(1, n + 1):
            options = [(end - 1, _OUTSIDE, 0.0)] + [(i, y, s[y]) for i, s in scores[end] for y in range(len(KINDS))]
            arrive = {i: total[i][:, None] + self.steps for i in {o[0] for o in options}}
            into = {i: (a.max(0), a.argmax(0)) if best else (_log_sum(a), None) for i, a in arrive.items()}
            for i, y, s in options:
                value = into[i][0][y] + s
                if best:
                    if value > total[end, y]:
                        total[end, y] = value
                        choice[end, y] = (i, int(into[i][1][y]))
                else:
                    total[end, y] = np.logaddexp(total[end, y], value)
        return (total, choice) if best else total

    def backward(self, scores) -> np.ndarray:
        """Log sum over what follows each end, by type of the segment before it."""
        n = len(scores) - 1
        follow = [[] for _ in range(n + 1)]
        for end in range(1, n + 1):
            follow[end - 1].append((end, _OUTSIDE, 0.0))
            for i, s in scores[end]:
                follow[i] += [(end, y, s[y]) for y in range(len(KINDS))]
        rest = np.full((n + 1, len(KINDS) + 1), -np.inf)
        rest[n] = 0
        for i in range(n - 1, -1, -1):
            for end, y, s in follow[i]:
                rest[i] = np.logaddexp(rest[i], self.steps[:, y] + s + rest[end, y])
        return rest

    def segments(self, scores) -> list[tuple[int, int, int, float]]:
        """Best segmentation: start, end and type of its segments, with their probability."""
        total, choice = self.forward(scores, best=True)
        all_ways, rest = self.forward(scores), None
        end, y, out = len(scores) - 1, int(total[-1].argmax()), []
        while end:
            i, before = choice[end, y]
            if y != _OUTSIDE:
                if rest is None:
                    rest = self.backward(scores)
                score = next(s for k, s in scores[end] if k == i)[y]
                into = _log_sum((all_ways[i][:, None] + self.steps)[:, [y]])[0]
                out.append((i, end, y, float(np.exp(into + score + rest[end, y] - rest[0, _OUTSIDE]))))
            end, y = i, before
        return out[::-1]

    def _scored(self, text: str, tokens: np.ndarray, lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """For each end after lo, up to hi: lengths in tokens of the segments that end there, longest first, and their scores."""
        first = max(0, lo - LONGEST)
        here = tokens[first:hi].tolist()
        opens = [text[a].isalnum() or text[a] in "+(" for a, _ in here]
        cues, marks = [_cue(text, a) if ok else "" for (a, _), ok in zip(here, opens)], [0]
        for a, _ in here:
            marks.append(marks[-1] + (text[a] in "0123456789@"))
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for end in range(lo - first + 1, hi - first + 1):
            stop, lengths, rows = here[end - 1][1], [], []
            if text[stop - 1].isalnum():
                for i in range(max(0, end - LONGEST), end):
                    if opens[i] and marks[end] > marks[i]:
                        f = _look(text, here[i][0], stop, cues[i])
                        if f is not None:
                            lengths.append(end - i)
                            rows.append(f)
            out.append((np.array(lengths), np.array(rows, float) @ self.weights.T) if rows else None)
        return out

    def _best_ahead(self, scored, edge: np.ndarray, choice: np.ndarray) -> np.ndarray:
        """Best scores of the last LONGEST + 1 ends, going on from those before the block; choices go to ``choice``."""
        kinds, old = np.arange(len(KINDS)), len(edge)
        ways = edge[:, :, None] + self.steps
        into = np.concatenate([ways.max(1), np.empty((len(scored), len(KINDS) + 1))])
        came = np.concatenate([ways.argmax(1), np.zeros((len(scored), len(KINDS) + 1), int)])
        total = np.concatenate([edge, np.full((len(scored), len(KINDS) + 1), -np.inf)])
        for k, segments in enumerate(scored):
            at = old + k
            total[at, _OUTSIDE] = into[at - 1, _OUTSIDE]
            choice[k, _OUTSIDE] = 1, came[at - 1, _OUTSIDE]
            if segments:
                lengths, s = segments
                value = into[at - lengths, :_OUTSIDE] + s
                top = value.argmax(0)
                total[at, :_OUTSIDE] = value[top, kinds]
                choice[k, :_OUTSIDE, 0] = lengths[top]
                choice[k, :_OUTSIDE, 1] = came[at - lengths[top], kinds]
            way = total[at][:, None] + self.steps
            into[at], came[at] = way.max(0), way.argmax(0)
        return total[-old:]

    def _sums_ahead(self, scored, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums at the ends of a block and LONGEST + 1 before it, and what they give to each type that follows."""
        old = len(edge)
        total = np.concatenate([edge, np.full((len(scored), len(KINDS) + 1), -np.inf)])
        into = np.concatenate([_log_sum((edge[:, :, None] + self.steps).swapaxes(0, 1)), np.empty((len(scored), len(KINDS) + 1))])
        for k, segments in enumerate(scored):
            at = old + k
            total[at, _OUTSIDE] = into[at - 1, _OUTSIDE]
            if segments:
                total[at, :_OUTSIDE] = _log_sum(into[at - segments[0], :_OUTSIDE] + segments[1])
            into[at] = _log_sum(total[at][:, None] + self.steps)
        return total, into

    def slide(self, text: str, tokens: np.ndarray) -> list[tuple[int, int, int, float]]:
        """What ``segments`` gives, in memory of ten bytes a token and one block of scores."""
        n, old = len(tokens), LONGEST + 1
        choice = np.zeros((n + 1, len(KINDS) + 1, 2), np.int8)
        best = np.full((old, len(KINDS) + 1), -np.inf)
        best[-1, _OUTSIDE] = 0
        edges, scored = [best], []
        for lo in range(0, n, BLOCK):
            scored = self._scored(text, tokens, lo, min(n, lo + BLOCK))
            best = self._best_ahead(scored, best, choice[lo + 1:])
            if n > BLOCK:
                edges.append(self._sums_ahead(scored, edges[-1])[0][-old:])
        end, y, path = n, int(best[-1].argmax()), []
        while end:
            back, before = map(int, choice[end, y])
            if y != _OUTSIDE:
                path.append((end - back, end, y))
            end, y = end - back, before
        if not path:
            return []

        if n <= BLOCK:
            edges.append(self._sums_ahead(scored, edges[0])[0][-old:])
        norm = _log_sum(edges[-1][-1])
        out, todo = [], {end: (i, y) for i, end, y in path}
        carry = np.full((old, len(KINDS) + 1), -np.inf)       # by end and type of the next segment
        for b in range(len(edges) - 2, -1, -1):
            lo, hi = b * BLOCK, min(n, b * BLOCK + BLOCK)
            if hi < n:
                scored = self._scored(text, tokens, lo, hi)
            into = self._sums_ahead(scored, edges[b])[1]
            after = np.concatenate([np.full((hi - lo, len(KINDS) + 1), -np.inf), carry])
            for end in range(hi, lo, -1):
                at = end - lo + LONGEST
                rest = _log_sum((self.steps + after[at]).T) if end < n else np.zeros(len(KINDS) + 1)
                segments = scored[end - lo - 1]
                if end in todo:
                    i, y = todo.pop(end)
                    score = segments[1][list(segments[0]).index(end - i), y]
                    out.append((i, end, y, float(np.exp(into[i - lo + LONGEST, y] + score + rest[y] - norm))))
                    if not todo:
                        return out[::-1]
                after[at - 1, _OUTSIDE] = rest[_OUTSIDE]
                if segments:
                    before = at - segments[0]
                    after[before, :_OUTSIDE] = np.logaddexp(after[before, :_OUTSIDE], segments[1] + rest[:_OUTSIDE])
            carry = after[:old]
        return out[::-1]

    def gradient(self, lattice, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected features and steps of a region."""
        scores = self.scores(lattice)
        ahead, rest = self.forward(scores), self.backward(scores)
        norm = rest[0, _OUTSIDE]
        d_weights, d_steps = np.zeros_like(self.weights), np.zeros_like(self.steps)

        def expect(i: int, end: int, s: np.ndarray, types) -> np.ndarray:
            way = ahead[i][:, None] + self.steps[:, types] + s[None, :] + rest[end][types][None, :] - norm
            p = np.exp(way)
            d_steps[:, types] -= p
            return p.sum(0)

        kinds = list(range(len(KINDS)))
        for end in range(1, len(scores)):
            expect(end - 1, end, np.zeros(1), [_OUTSIDE])
            for (i, f), (_, s) in zip(lattice[end], scores[end]):
                d_weights -= expect(i, end, s, kinds)[:, None] * f[None, :]
        at, last = 0, _OUTSIDE
        by_start = {i: (end, y) for (i, end), y in gold.items()}
        while at < len(scores) - 1:
            end, y = by_start.get(at, (at + 1, _OUTSIDE))
            d_steps[last, y] += 1
            if y != _OUTSIDE:
                d_weights[y] += next(f for i, f in lattice[end] if i == at)
            at, last = end, y
        return d_weights, d_steps


def _log_sum(a: np.ndarray) -> np.ndarray:
    return np.logaddexp.reduce(a, 0)


def _gold(field: Field, lattice, tokens, spans: list[Span]) -> dict[tuple[int, int], int]:
    """Base spans of a region that are candidate segments, the first of overlapping ones."""
    starts, ends = {t[0]: i for i, t in enumerate(tokens)}, {t[1]: i + 1 for i, t in enumerate(tokens)}
    out, taken = {}, [False] * len(tokens)
    for kind, start, stop in spans:
        i, j = starts.get(start), ends.get(stop)
        if i is not None and j is not None and not any(taken[i:j]) and any(k == i for k, _ in lattice[j]):
            out[i, j] = KINDS.index(kind)
            taken[i:j] = [True] * (j - i)
    return out


def train(texts: list[str]) -> Field:
    """A field fitted to the base spans of the texts, regions with spans and without alike."""
    field, cases = Field(), []
    for text in texts:
        spans = base_spans(text)
        for tokens in regions(text):
            if len(tokens) > 120 or len(cases) >= SAMPLE_REGIONS:
                continue
            for hide_plus in (False, True):
                lattice = field.lattice(text, tokens, hide_plus)
                gold = _gold(field, lattice, tokens, spans)
                if not hide_plus or any(KINDS[y] == "phone" for y in gold.values()):
                    cases.append((lattice, gold))
    sums_w, sums_s = np.full_like(field.weights, 1e-6), np.full_like(field.steps, 1e-6)
    for _ in range(ROUNDS):
        for lattice, gold in cases:
            dw, ds = field.gradient(lattice, gold)
            dw -= 1e-3 * field.weights
            ds -= 1e-3 * field.steps
            sums_w += dw * dw
            sums_s += ds * ds
            field.weights += 0.5 * dw / np.sqrt(sums_w)
            field.steps += 0.5 * ds / np.sqrt(sums_s)
    return field


def all_spans(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and what the field adds to them."""
    base = base_spans(text)
    if field is None:
        return base, []
    covered: list[list[int]] = []           # what base spans cover, without overlaps
    for _, start, stop in sorted(base, key=lambda span: span[1]):
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(stop, covered[-1][1])
        else:
            covered.append([start, stop])
    stops, added = [stop for _, stop in covered], []
    for tokens in regions(text):
        for i, end, y, p in field.slide(text, tokens):
            start, stop = int(tokens[i][0]), int(tokens[end - 1][1])
            next_ = bisect_right(stops, start)
            if p >= SURE and not (next_ < len(covered) and covered[next_][0] < stop):
                added.append((KINDS[y], start, stop))
    return base, added


def sample(docs: DataFrame) -> list[str]:
    """Texts to learn from: the smallest hashes among those with a digit or sign; at most SAMPLE_TEXTS."""
    some = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("k"), "text")
    keys = some.select("k").distinct().orderBy("k").limit(SAMPLE_TEXTS).agg(F.max("k")).first()[0]      # hashes are shuffled, not texts
    if keys is None:
        return []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the surroundings of digits and signs go to the driver, a bounded number a text
        for part in batches:
            near = []
            for text in part.column("text").to_pylist():
                pieces = [text[t[0][0]:t[-1][1]] for t, _ in zip(regions(text), range(4))]
                near.append("\n\n".join(pieces)[:4000])
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(near, pa.string())], ["k", "text"])

    taken = some.where(F.col("k") <= keys).mapInArrow(cut, "k long, text string").groupBy("k").agg(F.min("text").alias("text"))
    return sorted(r["text"] for r in taken.collect())


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (arrays of kind, start, stop in code points, stop exclusive) of every row."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = sample(lean)
    field = train(texts) if texts else None
    weights, steps = (field.weights, field.steps) if field else (None, None)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights, steps) if weights is not None else None
        for part in (p for b in batches for p in slices(b)):
            base, added = [], []
            for text in part.column("text").to_pylist():
                some = text and _TRIGGER.search(text)
                b, a = all_spans(text, own) if some else ([], [])
                base.append([dict(zip(span.names, s)) for s in b])
                added.append([dict(zip(span.names, s)) for s in a])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))],
                ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:int,stop:int>>"
    return lean.mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def find_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans, of every row."""
    order = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        order[s["kind"]].alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))), lambda s: s)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                             joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
