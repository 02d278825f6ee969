"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tags and blocks of text.  A tag is told apart by the elements around it and their class names, so
equal tags in different places are different tokens and tokens nest without crossing.  Tokens of the
pages of a host whose occurrence vectors over these pages are equal form an equivalence class; an element's opening and closing
tag are always in one.  Vectors are compared by a hash that is summed over pages, so they are never gathered.  A class counts
if it occurs on LEAST_PAGES pages and most pages of the host, and is valid if it is ordered and nested: its tags follow each
other in one order, on every page and each time they come again, and its outermost elements stand in one element of one
other class, or of the page.  An invalid class is taken apart into the pairs of tags of its elements, which are always
valid.  Classes in the slots of others are the template.  Numbers of posts in class names and identifiers are left out,
so that the tag of an article is the same token on all pages.

The inside of an element of a class is a slot, which holds text or further classes.  A page is matched with the template
of its host class by class, outermost first.  What goes, with all slots and classes inside:

- elements that are menus, headers, footers, sidebars, notices, adverts, forms or comments by their tag or, outside of the
  article, by a whole word of their names;
- slots on most pages of the host with one and the same text on most of them, inside the article as well.  Pages are
  counted by their articles, or heaviest slots, so that copies of a page are one, and a slot with more than half
  of the text around it is neither counted nor dropped;
- outside of the article, slots of classes of several elements whose text is mostly links on this page and over the host.

Of the rest, those inside an article or main element of the page itself are the main text or, on pages without one, all
but blocks of several links that are most of the block's text.  Words are no tokens, so a paragraph that many
pages share stays.

A page whose host shows too few pages for a template is judged by its own tags and names.

Null and empty pages give an empty text.  Every input row gives one row, repeated rows alike; a row with a null
``page_id`` or ``url`` is a page like others, null hosts are one host.  Clashing extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .words import slices

#: A template token occurs on this share of the host's pages, and on this many at least.
SHARE, LEAST_PAGES = 0.6, 3
#: Elements whose text is not part of an article, and the like for class names, identifiers and roles.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "noscript", "iframe",
         "svg", "canvas", "template", "head", "title", "script", "style", "textarea", "object", "video", "audio"}
ASIDE_NAME = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|form|header|legal|login|masthead|"
    r"menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|search|share|sharing|"
    r"side-?bar|social|sponsor\w*|subscribe|tags|toolbar|widget", re.I)
MAIN = {"article", "main"}
#: Elements that do not end a block of text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end at the next of the same kind.
CLOSED_BY_SAME = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}

# attributes end at a bracket of either kind outside of quotes and are never read twice, so a run of unfinished tags is read once
_ATTRIBUTES = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
_PARTS = re.compile(
    r"<!--(?:.*?-->|.*)|<(script|style|textarea|title|noscript|template|svg)\b" + _ATTRIBUTES + r">(.*?)(?:</\1\s*+>|\Z)|<[!?][^>]*>?"
    r"|</?([a-zA-Z][^\s/<>]*+)(" + _ATTRIBUTES + r")>|([^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Numbers that count posts in a class name.
_COUNTED = re.compile(r"(?<=[-_])\d+(?![^\s_-])")
_BLANKS = re.compile(r"\s+")

Token = tuple[str, str, str]


def page_tokens(page: str) -> Iterator[Token]:
    """Tokens as (kind, name, value): open and close with element and attributes, text with its characters.

    Kind is ``open``, ``close``, ``empty`` or ``text``; comments, declarations and raw elements are left out.
    """
    for m in _PARTS.finditer(page):
        if m[5] is not None:
            yield "text", "", m[5]
        elif m[3]:
            name = m[3].lower()
            if m[0][1] == "/":
                yield "close", name, ""
            else:
                yield ("empty" if name in VOID else "open"), name, m[4]


@lru_cache(1 << 16)
def _names(attributes: str) -> tuple[str, str]:
    """Class names, identifiers and roles: all, and those that tell an element apart on every page.

    For the latter numbers of posts are alike, and identifiers made of the words of a heading are left out.
    """
    every, kept = [], []
    for key, a, b, c in _NAMES.findall(attributes):
        value = a or b or c
        every.append(value)
        if key.lower() != "id":
            kept.append(_COUNTED.sub("0", value))
        elif len(re.findall("[-_ ]", value)) < 2:
            kept.append(re.sub(r"\d+", "0", value))
    return " ".join(every), " ".join(kept)


@lru_cache(1 << 16)
def _inner(token: int, label: str) -> int:
    """Hash of a tag in the place with this hash."""
    return int.from_bytes(blake2b(label.encode(), digest_size=8, key=token.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


def token_of(path: tuple[str, ...]) -> int:
    """Hash of a tag in its place, inline elements left out."""
    token = 0
    for p in path:
        if p.split(".", 1)[0] not in INLINE:
            token = _inner(token, p)
    return token


def _folded(whole: int, part: int) -> int:
    return (whole * 0x9E3779B97F4A7C15 + part * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@dataclass
class Slot:
    """Hash and characters of a text, those linked, those of the article or page around, and whether it is outside of the article."""

    content: int = 0
    chars: int = 0
    linked: int = 0
    around: int = 0
    outside: bool = True

    @property
    def is_minor(self) -> bool:
        return 2 * self.chars <= self.around


def _last(names: list[str], name: str) -> int:
    """Place of the last of equal names, looked for from the end; far ones by a faster search of all."""
    for at in range(len(names) - 1, max(-1, len(names) - 33), -1):
        if names[at] == name:
            return at
    return len(names) - 1 - names[::-1].index(name)


class Tree:
    """Elements of a page in the order they open; the first is the page itself, and parents come before children.

    ``events`` has (element, text, whether it is linked) for texts and (element, None, False) where a block ends.
    """

    def __init__(self, page: str):
        self.parent, self.name, self.names, self.token = [0], [""], [""], [0]
        self.events: list[tuple[int, str | None, bool]] = []
        path, bare, links = [0], [""], 0      # open elements and their names
        held = Counter(bare)

        def end(at: int, stop: int) -> None:
            held.subtract(bare[at:stop])
            del path[at:stop], bare[at:stop]

        for kind, name, value in page_tokens(page):
            if kind == "text":
                self.events.append((path[-1], value, links > 0))
                continue
            if kind == "close":
                if held[name] > 0:
                    at = _last(bare, name)
                    if name not in INLINE:
                        self.events.append((path[at], None, False))
                    # an inline element left open does not hold a block open, nor the other way round
                    if name not in INLINE or all(b in INLINE for b in bare[at:]):
                        links -= bare[at:].count("a")
                        end(at, len(bare))
                    else:
                        links -= name == "a"
                        end(at, at + 1)
                continue
            if name in CLOSED_BY_SAME and held[name] > 0:
                at = _last(bare, name)
                if all(b in INLINE or b == name for b in bare[at:]):
                    links -= bare[at:].count("a")
                    end(at, len(bare))
            outer, (names, label) = self.token[path[-1]], _names(value) if value else ("", "")
            self.parent.append(path[-1])
            self.name.append(name)
            self.names.append(names)
            self.token.append(outer if name in INLINE else _inner(outer, f"{name}.{label}" if label else name))
            if name not in INLINE:
                self.events.append((len(self.name) - 1, None, False))
            if kind == "open":
                path.append(len(self.name) - 1)
                bare.append(name)
                held[name] += 1
                links += name == "a"

    def inherited(self, marks: list[bool]) -> list[bool]:
        """Whether an element or one around it is marked."""
        out = list(marks)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def summed(self, values: list[int]) -> list[int]:
        """Sums over elements and all inside them."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def tokens(self) -> Counter[int]:
        return Counter(t for t, name in zip(self.token[1:], self.name[1:]) if name not in INLINE)

    def places(self) -> dict[int, tuple[int, list[int]]]:
        """The token around each token, and where its elements open."""
        out: dict[int, tuple[int, list[int]]] = {}
        for e in range(1, len(self.name)):
            if self.name[e] not in INLINE:
                out.setdefault(self.token[e], (self.token[self.parent[e]], []))[1].append(e)
        return out

    def contents(self) -> list[int]:
        """Hash of the text of every element, 0 for none."""
        out = [0] * len(self.name)
        for e, text, _ in self.events:
            if text is not None and (text := _BLANKS.sub(" ", text).strip()):
                out[e] = _folded(out[e], int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big"))
        for e in range(len(out) - 1, 0, -1):
            if out[e]:
                out[self.parent[e]] = _folded(out[self.parent[e]], out[e])
        return out

    def slots(self) -> dict[int, Slot]:
        """Elements of a token together, for every token with text on the page that does not hold the article."""
        (total, linked), contents, main = self.sizes(), self.contents(), _main_elements(self)
        inside, holds = self.inherited(main), self.summed([int(m) for m in main])
        around = sum(t for e, t in enumerate(total) if main[e] and not inside[self.parent[e]])
        out: dict[int, Slot] = {}
        for e in range(1, len(self.name)):
            if total[e] and not holds[e] and self.name[e] not in (*INLINE, "html", "body"):
                slot = out.setdefault(self.token[e], Slot())
                slot.content = _folded(slot.content, contents[e])
                slot.chars += total[e]
                slot.linked += linked[e]
                slot.outside = slot.outside and not inside[e]
                slot.around = around if inside[e] else total[0]
        return out

    def own_content(self) -> int:
        """Hash of the article or, without one, of the heaviest slot by its own text."""
        contents, main = self.contents(), _main_elements(self)
        inside, key = self.inherited(main), 0
        for e, m in enumerate(main):
            if m and not inside[self.parent[e]] and contents[e]:
                key = _folded(key, contents[e])
        if not key:
            heavy: dict[int, list[int]] = {}
            for e, text, is_link in self.events:
                if text is not None and not is_link and (text := text.strip()):
                    slot = heavy.setdefault(self.token[e], [0, 0])
                    slot[0] += len(text)
                    slot[1] = _folded(slot[1], int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big"))
            key = max(heavy.values(), default=[0, 0])[1]
        return _signed(key)

    def sizes(self, left_out: list[bool] | None = None) -> tuple[list[int], list[int]]:
        """Characters of the text in every element, and how many of them are linked."""
        total, linked = [0] * len(self.name), [0] * len(self.name)
        for e, text, is_link in self.events:
            if text is not None and not (left_out and left_out[e]):
                n = len(text.strip())
                total[e] += n
                linked[e] += n * is_link
        return self.summed(total), self.summed(linked)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for b in batches for p in slices(b, "html")):
        rows = []
        for host, key, page in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html"))):
            tree = Tree(page or "")
            slots, none = tree.slots(), Slot()
            rows.append({"host": host, "page": key, "own": tree.own_content(), "tags": [
                {"token": t, "outer": outer, "at": at, "content": _signed(slot.content), "minor": int(slot.is_minor),
                 "chars": slot.chars * slot.outside, "linked": slot.linked * slot.outside}
                for t, (outer, at) in tree.places().items() for slot in (slots.get(t, none),)]})
        yield pa.RecordBatch.from_pylist(rows, _OCCURRENCES)


_OCCURRENCES = pa.schema([("host", pa.string()), ("page", pa.int64()), ("own", pa.int64()), ("tags", pa.list_(pa.struct([
    ("token", pa.int64()), ("outer", pa.int64()), ("at", pa.list_(pa.int64())), ("content", pa.int64()), ("minor", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])))])


def _valid_classes(common: DataFrame, each: DataFrame) -> DataFrame:
    """host, token, outer, menu, class and place in it: tokens by valid class, those of invalid classes each by itself."""
    several = common.withColumn("n_tokens", F.count("*").over(Window.partitionBy("host", "vector")))
    # one row a class and page, from the tags of that page alone; copies of a page are one
    placed = each.select("host", "page", "token", F.size("at").alias("n"), F.explode("at").alias("at")).join(
        several.where("n_tokens >= 2").select("host", "token", "vector"), ["host", "token"])
    seen = placed.groupBy("host", "vector", "page").agg(
        F.transform(F.sort_array(F.collect_set(F.struct("at", "token"))), lambda t: t["token"]).alias("tags"), F.max("n").alias("n"))
    once = F.slice("tags", F.lit(1), F.call_function("div", F.size("tags"), F.col("n")).cast("int"))
    order = seen.select("host", "vector", once.alias("once"), (F.flatten(F.array_repeat(once, F.col("n"))) == F.col("tags")).alias("again")).groupBy(
        "host", "vector").agg((F.bool_and("again") & (F.min("once") == F.max("once"))).alias("ordered"), F.min("once").alias("order"))
    found = several.join(order, ["host", "vector"], "left")
    # where the outermost elements of a class stand
    inner = found.select("host", F.col("token").alias("outer"), F.col("vector").alias("around"))
    stands = found.select("host", "vector", "outer").join(inner, ["host", "outer"], "left").where(~F.col("vector").eqNullSafe(F.col("around"))).groupBy(
        "host", "vector").agg((F.min("outer") == F.max("outer")).alias("nested"))
    whole = (F.col("n_tokens") == 1) | F.coalesce(F.col("ordered") & F.col("nested"), F.lit(False))
    return found.join(stands, ["host", "vector"], "left").select(
        "host", "token", "outer", ((F.col("n_tokens") >= 2) & (2 * F.col("linked") > F.col("chars"))).alias("menu"),
        F.when(whole, F.col("vector")).otherwise(F.col("token")).alias("class"),
        F.when(whole, F.coalesce(F.array_position("order", F.col("token")), F.lit(1))).otherwise(F.lit(1)).alias("place"))


def templates(pages: DataFrame) -> DataFrame:
    """host, the tokens of its template and the classes these form.

    A class has the slot it stands in, ``outer`` (0 is the page), and its ``slots`` in their order: the token, the hash of its text
    where it repeats, and whether it is one of links.  ``pages`` has host, page (a hash of the row) and html.
    """
    found = materialize(pages.mapInArrow(_occurrences, "host string, page long, own long, tags array<struct<"
                                         "token:long,outer:long,at:array<long>,content:long,minor:long,chars:long,linked:long>>"), "occurrences")
    sizes = found.groupBy("host").agg(F.count("*").alias("n_pages"))
    each = found.select("host", "page", "own", F.explode("tags").alias("t")).select("host", "page", "own", "t.*")
    # the hash of an occurrence vector is a sum over pages, so it is pre-aggregated in every task
    vectors = each.groupBy("host", "token").agg(
        F.count("*").alias("on_pages"), F.sum(F.xxhash64("page", F.size("at").cast("long")).cast("decimal(38,0)")).alias("vector"),
        F.min("outer").alias("outer"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    common = materialize(vectors.join(sizes, "host").where(
        (F.col("on_pages") >= LEAST_PAGES) & (F.col("on_pages") >= SHARE * F.col("n_pages"))), "tokens")
    valid = _valid_classes(common, each)
    # copies of an article count once, grouped in every task before they meet
    texts = each.where("content <> 0").groupBy("host", "token", "content", "own").agg(F.max("minor").alias("minor")).groupBy(
        "host", "token", "content").agg(F.sum("minor").alias("minor"), F.count("*").alias("n"))
    most = texts.groupBy("host", "token").agg(F.max(F.struct("minor", "content")).alias("top"), F.sum("n").alias("n"))
    repeated = most.where((F.col("top.minor") >= LEAST_PAGES) & (F.col("top.minor") >= SHARE * F.col("n"))).select(
        "host", "token", F.col("top.content").alias("content"))
    slots = valid.join(repeated, ["host", "token"], "left")
    # the outer token of a class is that of its first element
    classes = slots.groupBy("host", "class").agg(F.sort_array(F.collect_list(F.struct("place", "token", "outer", "content", "menu"))).alias("s"))
    return classes.groupBy("host").agg(
        F.flatten(F.collect_list(F.col("s.token"))).alias("template"),
        F.collect_list(F.struct(F.col("s")[0]["outer"].alias("outer"), F.transform(
            "s", lambda x: F.struct(x["token"].alias("token"), x["outer"].alias("outer"), x["content"].alias("content"),
                                    x["menu"].alias("menu"))).alias("slots"))).alias("classes"))


class Template:
    """The classes of a host, each in the slot of the class around it."""

    def __init__(self, classes: list[dict]):
        self.inside: dict[int, list[list[dict]]] = {}
        for c in classes:
            self.inside.setdefault(c["outer"], []).append(c["slots"])

    def gone(self, tree: Tree) -> set[int]:
        """Slots of a page that hold the text of the template or its menus, without those inside of them."""
        slots, out, todo = tree.slots(), set(), [0]
        while todo:
            for members in self.inside.get(todo.pop(), ()):
                closed: set[int] = set()
                for s in members:
                    t, slot = s["token"], slots.get(s["token"])
                    if s["outer"] in closed:
                        closed.add(t)
                    elif slot and (slot.is_minor and s["content"] == _signed(slot.content)
                                   or s["menu"] and slot.outside and 2 * slot.linked > slot.chars):
                        closed.add(t)
                        out.add(t)
                    else:
                        todo.append(t)
        return out


def _main_elements(tree: Tree) -> list[bool]:
    return [name in MAIN or name not in ("html", "body") and "main" in names.lower().split() for name, names in zip(tree.name, tree.names)]


def _asides(tree: Tree, total: list[int]) -> tuple[list[bool], list[bool]]:
    """Which elements are inside menus and the like, and which inside article or main.

    Names count as whole words outside of the article only.  An element that holds the article is none, unless there is an
    article outside of all of them: then the others are comments or links to further articles.
    """
    main = _main_elements(tree)
    article = tree.summed([int(n == "article") for n in tree.name])
    core = tree.inherited([m and (tree.name[e] == "article" or not article[e]) for e, m in enumerate(main)])
    marks = [name in ASIDE or not core[e] and name not in ("html", "body", *MAIN) and any(map(ASIDE_NAME.fullmatch, names.split()))
             for e, (name, names) in enumerate(zip(tree.name, tree.names))]
    aside = tree.inherited(marks)
    if not any(m and t and not a for m, t, a in zip(main, total, aside)):
        holds = tree.summed([int(m and t > 0) for m, t in zip(main, total)])
        aside = tree.inherited([a and not h for a, h in zip(marks, holds)])
    return aside, tree.inherited(main)


def _menus(tree: Tree, aside: list[bool]) -> list[bool]:
    """Elements of a page without article whose text is mostly several links, beside others or around all the rest."""
    total, linked = tree.sizes(aside)
    links, inside = tree.summed([int(n == "a") for n in tree.name]), [[] for _ in tree.name]
    for e in range(1, len(tree.name)):
        if total[e]:
            inside[tree.parent[e]].append(e)
    marks, at = [False] * len(tree.name), 0
    while inside[at]:
        heavy = {e for e in inside[at] if tree.name[e] not in INLINE and links[e] > 1 and 2 * linked[e] > total[e]}
        own = total[at] - sum(total[e] for e in inside[at])
        rest = [e for e in inside[at] if e not in heavy]
        if not rest and not own:                                       # links are all that is there
            if len(inside[at]) > 1:
                break
            rest, heavy = inside[at], set()
        for e in heavy:
            marks[e] = True
        if len(rest) != 1 or own:
            break
        at = rest[0]
    return tree.inherited(marks)


def main_text(page: str | None, template: Template | None = None) -> str:
    """Text of the slots that are left when what repeats in the template of the host, its menus and the like are taken away."""
    if not page:
        return ""
    tree = Tree(page)
    total, _ = tree.sizes()
    aside, main = _asides(tree, total)
    if template and (gone := template.gone(tree)):
        less = tree.inherited([t in gone and name not in INLINE for t, name in zip(tree.token, tree.name)])
        less = [a or b for a, b in zip(aside, less)]
        # a page of nothing else keeps its text
        if any(text is not None and not less[e] and text.strip() for e, text, _ in tree.events):
            aside = less
    if any(text is not None and main[e] and not aside[e] and text.strip() for e, text, _ in tree.events):
        kept = [m and not a for m, a in zip(main, aside)]
    else:
        kept = [not a and not m for a, m in zip(aside, _menus(tree, aside))]
    return _blocks(tree, kept)


def _blocks(tree: Tree, kept: list[bool]) -> str:
    """Text of the kept elements, blocks apart by a blank."""
    out: list[str] = [""]
    for e, text, _ in tree.events:
        if text is None:
            out.append("")
        elif kept[e]:
            out[-1] += html.unescape(text)
    return " ".join(t for t in (_BLANKS.sub(" ", b).strip() for b in out) if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    lean = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"))
    known = materialize(templates(lean.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for part in (p for b in batches for p in slices(b, "html")):
            texts, classes = [], part.column("classes")
            for row, (host, page) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist())):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = Template(classes[row].as_py() or [])
                texts.append(main_text(page, known[host]))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return lean.join(known.drop("template"), "host", "left").select("page_id", "url", "html", "host", "classes").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
