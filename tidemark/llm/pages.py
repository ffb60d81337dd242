"""Main text of web pages by templates deduced per host from equivalence classes of tokens."""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ready
from tidemark.session import stage

# Elements and words of HTML pages.
RAW_TEXT = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside form button select option input dialog menu search svg math object embed canvas audio video map".split())
#: Words of classes, ids and roles that count as evidence against an element.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login "
    "masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related recommended respond reply replies "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
WITHOUT = frozenset("has with no not without".split())
CONTENT = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | {"p"}
#: Elements whose start ends an open element of the same kind, up to the element that holds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: Evidence that removes a slot, and what it takes for one that holds over half of the text.
AGAINST, AGAINST_HALF = 3, 4
#: A slot is short below this share of a page's text, late if at least ``BEFORE`` of it come earlier and at most ``AFTER`` later.
SHORT, BEFORE, AFTER = 0.25, 0.3, 0.05
#: Share of a slot's text in links from which on it is a list of links.
LINKS = 0.5
#: Elements seen on less than one of so many pages of a host are judged on their own page; bounds the tokens of a host.
RARE = 50
#: Texts of the template may hold so much of the main slot at most; beyond, the pages are copies and the texts are content.
MOST_FIXED = 0.3
#: Share of the text that a child must hold for the main slot to move down to it: ``MASS`` at least, all of it on a host of one page and a
#: ``1 / DOUBLINGS`` less with every doubling of its distinct pages; and the same where it is or holds an article or main element.
MASS, DOUBLINGS, MASS_NAMED = 0.6, 8, 0.25
#: Tokens summed up in a task before they are handed on.
HELD = 100_000

_tag = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_raw_end = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW_TEXT}
_attribute = re.compile(r"\b(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_digits = re.compile(r"\d+")
_key_name, _key_words = re.compile(r"[^.#]*"), re.compile(r"([.#])([^.#]+)")
ROOT = 0


@lru_cache(maxsize=1 << 16)
def _path(parent: int, key: str) -> int:
    """Token of an element in its context: the same for the same chain of element names, classes and ids."""
    return int.from_bytes(xxhash.xxh64_digest(f"{parent}/{key}"), "big", signed=True)


@lru_cache(maxsize=1 << 15)
def _element(name: str, attributes: str) -> tuple[str, bool]:
    """``(key, dropped)``: name with classes and ids (numbers made alike), and whether the element itself shows no main text."""
    words, hidden = [], False
    for kind, *values in _attribute.findall(attributes):
        if kind.lower() == "hidden":
            hidden = True
        else:
            words += [("#" if kind.lower() == "id" else ".") + w.lower() for w in "".join(values).split()]
    return name + "".join(_digits.sub("0", w) for w in words), hidden or name in DROPPED


@lru_cache(maxsize=1 << 15)
def _word_points(key: str) -> int:
    """What the words of an element's key say against it: 2 for a class or an id of listed words alone or a class that starts or ends with one, 1 for such an id."""
    most = 0
    for kind, word in _key_words.findall(key):
        parts = [w for w in re.split(r"[^a-z]+", word) if w]
        if not parts or parts[0] in WITHOUT:
            continue
        if all(w in DROPPED_WORDS for w in parts) or kind == "." and (parts[0] in DROPPED_WORDS or parts[-1] in DROPPED_WORDS):
            return 2
        if parts[0] in DROPPED_WORDS or parts[-1] in DROPPED_WORDS:
            most = 1
    return most


def _name(key: str) -> str:
    return _key_name.match(key).group()


class Page:
    """Elements and text blocks of one page, in order; time and memory are linear in the page, however deep it nests."""

    __slots__ = ("nodes", "blocks")

    def __init__(self, source: str):
        self.nodes: list[tuple[int, int, str, int]] = [(ROOT, -1, "", 0)]  # token, place of the element around, key, shown characters before
        self.blocks: list[tuple[int, str, int, bool]] = []  # place of the innermost element, text, characters in links, dropped
        self._read(source)

    def totals(self) -> dict[int, list]:
        """Per element token: token around, key, occurrences, shown characters below, of these in links, before the first and after the last one."""
        n = len(self.nodes)
        chars, links = [0] * n, [0] * n
        for node, text, linked, dropped in self.blocks:
            if not dropped:
                chars[node] += len(text)
                links[node] += min(linked, len(text))
        for node in range(n - 1, 0, -1):
            around = self.nodes[node][1]
            chars[around] += chars[node]
            links[around] += links[node]
        seen: dict[int, list] = {}
        for node, (token, around, key, before) in enumerate(self.nodes):
            after = chars[0] - before - chars[node]
            now = seen.get(token)
            if now is None:
                seen[token] = [self.nodes[around][0] if around >= 0 else ROOT, key, 1, chars[node], links[node], before, after]
            else:
                now[2] += 1
                now[3] += chars[node]
                now[4] += links[node]
                now[6] = after
        return seen

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool, bool, int]] = []  # name, node, dropped, inside content, inside a link, place of the innermost block
        places: dict[str, list[int]] = {}  # name → places of open elements in the stack
        texts: list[str] = []
        linked = at = shown = 0

        def flush() -> None:
            nonlocal linked, shown
            if texts:
                text = " ".join("".join(texts).split())
                if text:
                    dropped = bool(stack) and stack[-1][2]
                    self.blocks.append((stack[-1][1] if stack else 0, text, linked, dropped))
                    shown += 0 if dropped else len(text)
                texts.clear()
            linked = 0

        def add(text: str) -> None:
            nonlocal linked
            if text:
                if "&" in text:
                    text = entities.unescape(text)
                texts.append(text)
                if stack and stack[-1][4]:
                    linked += len(text)

        def cut(place: int) -> None:
            while len(stack) > place:
                places[stack.pop()[0]].pop()

        while (found := _tag.search(source, at)) is not None:
            add(source[at : found.start()])
            at = found.end()
            closing, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            block = name in BLOCKS
            if closing:
                if places.get(name):
                    place = places[name][-1]
                    if block or stack[-1][5] >= place:
                        flush()
                    cut(place)
                elif block:
                    flush()
                continue
            if block:
                flush()
                if stack and stack[-1][5] >= 0 and stack[stack[-1][5]][0] == "p":  # a block ends an open paragraph
                    cut(stack[-1][5])
            if name in ENDS:
                same, until = ENDS[name]
                holder = max((places[n][-1] for n in until if places.get(n)), default=-1)
                open_ones = [places[n][i] for n in same if places.get(n) and (i := bisect_right(places[n], holder)) < len(places[n])]
                if open_ones:
                    cut(min(open_ones))
            if name == "br":
                texts.append(" ")
            key, dropped = _element(name, attributes)
            above = stack[-1] if stack else ("", 0, False, False, False, -1)
            node = above[1]
            if block or name in RAW_TEXT:
                node = len(self.nodes)
                self.nodes.append((_path(self.nodes[above[1]][0], key), above[1], key, shown))
            inside = above[3] or name in CONTENT
            dropped = above[2] or dropped or name == "header" and not inside
            if name in RAW_TEXT:
                end = _raw_end[name].search(source, at)
                at = end.end() if end else len(source)
            elif name not in VOID and not attributes.endswith("/"):
                places.setdefault(name, []).append(len(stack))
                stack.append((name, node, dropped, inside, above[4] or name == "a", len(stack) if block else above[5]))
        rest = source[at:]
        add(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^>]*\Z", rest) else rest)  # a tag cut off at the end
        flush()


def _text_token(path: int, text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(f"{path}\n{text}"), "big", signed=True)


_COUNTS = ("low", "high", "pages", "total", "chars", "links", "before", "after")
TOKENS = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("token", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("key", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in _COUNTS]
)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrence vectors of all tokens of the pages of a partition, folded: two sums of 32-bit hashes of (page, count)."""
    held: dict[tuple[str, int], list] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, t, *v) for (h, t), v in held.items()]
        held.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * len(_COUNTS)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=TOKENS.names)

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(source)
            seen = page.totals()
            for node, text, _, dropped in page.blocks:
                if not dropped:
                    path = page.nodes[node][0]
                    now = seen.setdefault(_text_token(path, text), [path, None, 0, 0, 0, 0, 0])
                    now[2] += 1
                    now[3] += len(text)
            which = xxhash.xxh64_digest(source.encode("utf-8", "surrogatepass"))
            marks: dict[int, int] = {}
            for token, (parent, key, count, chars, links, before, after) in seen.items():
                mark = marks.get(count)
                if mark is None:
                    mark = marks[count] = xxhash.xxh64_intdigest(which + count.to_bytes(8, "big"))
                now = held.setdefault((host, token), [parent, key, *[0] * len(_COUNTS)])
                for at, value in enumerate((mark & 0xFFFFFFFF, mark >> 32, 1, count, chars, links, before, after), 2):
                    now[at] += value
            if len(held) >= HELD:
                yield out()
    if held:
        yield out()


TEMPLATE = "host string, n_classes int, main long, against array<long>, kept array<long>, fixed array<long>"


def _vector(t: dict) -> tuple:
    return t["low"], t["high"], t["pages"], t["total"]


def _from_outside(elements: dict[int, dict]) -> tuple[list[int], dict[int, list[int]]]:
    """Tokens with the one around each before it, and the tokens right below each. Those whose surroundings are not told are left out."""
    below: dict[int, list[int]] = {}
    for token, e in elements.items():
        if token != ROOT:
            below.setdefault(e["parent"], []).append(token)
    order = [ROOT]
    for token in order:
        order += sorted(below.get(token, ()))
    return order, below


def judge(elements: dict[int, dict], below: dict[int, list[int]]) -> tuple[set[int], set[int]]:
    """``(against, kept)``: slots that show no main text, and those of which something but not enough speaks for that.

    Evidence: words of classes and ids (up to 2), mostly links (1, and 1 more with a class or id), short beside the page's text (1), late,
    so that most text comes before and next to none but that of slots already judged after (1), and a repeated unit below that holds most
    of the text (1, and 1 more if it is a record of several parts without a heading, as reader comments are). ``AGAINST`` points
    remove a slot, ``AGAINST_HALF`` one that holds over half of the text.
    """
    whole = elements[ROOT]
    usual = whole["chars"] / max(1, whole["pages"])
    against, kept, gone = set(), set(), 0.0
    for token, e in sorted(elements.items(), key=lambda x: (x[1]["after"] / x[1]["pages"], -x[1]["chars"], x[0])):
        name = _name(e["key"])
        if not e["chars"] or name in ("", "html", "body"):
            continue
        held, links = e["chars"] / e["pages"], e["links"] > LINKS * e["chars"]
        text = name in CONTENT or name in PARAGRAPHS
        points = _word_points(e["key"]) + links + (links and name != e["key"]) + (held < SHORT * usual and name not in CONTENT)
        points += not text and e["before"] / e["pages"] >= BEFORE * usual and e["after"] / e["pages"] - gone <= AFTER * usual
        units = [t for t in below.get(token, ()) if 2 * elements[t]["total"] >= 3 * elements[t]["pages"] and 2 * elements[t]["chars"] > e["chars"]]
        if units and not text:
            unit = elements[units[0]]
            if _name(unit["key"]) not in PARAGRAPHS and (name != e["key"] or unit["key"] != _name(unit["key"])):
                parts = [_name(elements[t]["key"]) for t in below.get(units[0], ())]
                points += 2 if len(parts) > 1 and not HEADINGS.intersection(parts) else 1
        if points >= (AGAINST if 2 * e["chars"] <= whole["chars"] else AGAINST_HALF):
            against.add(token)
            gone += 0.0 if e["parent"] in against else e["chars"] / max(1, whole["pages"])
        elif points:
            kept.add(token)
    return against, kept


def deduce(tokens: list[dict], distinct: int) -> dict:
    """Template of one host from its tokens: ``n_classes``, ``main`` slot, slots ``against`` and ``kept``, ``fixed`` texts.

    Tokens with the same occurrence vector form an equivalence class. A class is valid if its elements lie nested: all below one
    element of the class around it. The class of the page itself is the outermost; the others nest in the class of the nearest
    element around them. The slots between their elements hold the text. :func:`judge` tells which of them show none of the article. From the
    outside in, the main slot is the deepest one that holds most of the remaining text (an article or main element needs less, and an
    article is not entered), unless a heading that varies would stay behind. Texts of the outermost class inside it are part of the
    template if the number of distinct pages, in powers of two, and their shortness together say so as loudly as :func:`judge` asks.
    """
    elements = {t["token"]: t for t in tokens if t["key"] is not None}
    if ROOT not in elements:
        return {"n_classes": 0, "main": None, "against": [], "kept": [], "fixed": []}
    order, below = _from_outside(elements)
    elements = {t: elements[t] for t in order}
    outermost = _vector(elements[ROOT])
    outside: dict[int, int] = {ROOT: ROOT}  # nearest element of another class around
    around: dict[tuple, set] = {}
    for token in order[1:]:
        up = elements[token]["parent"]
        outside[token] = outside[up] if _vector(elements[up]) == _vector(elements[token]) else up
        around.setdefault(_vector(elements[token]), set()).add(_vector(elements[outside[token]]))
    valid = {v for v, found in around.items() if len(found) == 1} | {outermost}

    against, kept = judge(elements, below)
    constant = {}
    for t in tokens:
        if t["key"] is None and _vector(t) == outermost:
            constant[t["parent"]] = constant.get(t["parent"], 0) + t["chars"]
    net, heading, named = {}, {}, {}
    for token in reversed(order):
        e, name = elements[token], _name(elements[token]["key"])
        inner = below.get(token, ())
        net[token] = 0 if token in against else e["chars"] - sum(elements[t]["chars"] - net[t] for t in inner)
        heading[token] = net[token] > 0 and (name == "h1" and 2 * constant.get(token, 0) < e["chars"] or any(heading[t] for t in inner))
        named[token] = net[token] > 0 and (name in CONTENT and 2 * e["total"] <= 3 * e["pages"] or any(named[t] for t in inner))
    loud = math.log2(max(1, distinct))
    mass = max(MASS, 1 - loud / DOUBLINGS)
    main = ROOT
    while _name(elements[main]["key"]) != "article":
        at = _name(elements[main]["key"]) == "main"
        slots = [t for t in below.get(main, ()) if net[t] > 0 and _vector(elements[t]) in valid and _name(elements[t]["key"]) not in PARAGRAPHS]
        slots = [t for t in slots if 2 * elements[t]["pages"] > elements[ROOT]["pages"] and 2 * elements[t]["total"] <= 3 * elements[t]["pages"]]
        best = max(slots, key=lambda t: (named[t], net[t], t), default=None)
        if best is None or at and not named[best] or net[best] < (MASS_NAMED if named[best] else mass) * net[main]:
            break
        if not named[best] and not heading[best] and any(heading[t] for t in below[main]):
            break
        main = best
    inside, queue = {main}, [main]
    for token in queue:
        queue += [t for t in below.get(token, ()) if t not in against]
    inside.update(queue)
    texts = [t for t in tokens if t["key"] is None and _vector(t) == outermost and t["parent"] in inside]
    usual = elements[ROOT]["chars"] / max(1, elements[ROOT]["pages"])
    fixed = [t["token"] for t in texts if loud + (t["chars"] / t["pages"] < SHORT * usual) >= AGAINST]
    if sum(t["chars"] for t in texts) > MOST_FIXED * net[main]:
        fixed = []
    return {"n_classes": len(valid), "main": main if main != ROOT else None, "against": sorted(against), "kept": sorted(kept), "fixed": sorted(fixed)}


def _templates(key: tuple, rows: pa.Table) -> pa.Table:
    tokens = rows.to_pylist()
    found = deduce(tokens, tokens[0]["distinct"] or 0)
    kinds = {"n_classes": pa.int32(), "main": pa.int64(), **dict.fromkeys(("against", "kept", "fixed"), pa.list_(pa.int64()))}
    return pa.table({"host": pa.array([key[0].as_py()], pa.string())} | {c: pa.array([found[c]], kind) for c, kind in kinds.items()})


def templates(pages: DataFrame) -> DataFrame:
    """One template per host from ``pages`` (``host, html``), over all its pages.

    Occurrence vectors and the text below each element are summed where pages are read and then by Spark. A host's deduction gets its
    elements on at least one of ``RARE`` pages, which are ``RARE`` times those of a page at most, and the texts that occur on every page.
    """
    counted = pages.select("host", "html").mapInArrow(_count_tokens, TOKENS)
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    tokens = stage(counted.groupBy("host", "token").agg(F.max("parent").alias("parent"), F.max("key").alias("key"), *sums), "tokens")
    distinct = pages.select(F.col("host").alias("h2"), F.xxhash64("html").alias("page")).distinct().groupBy("h2").agg(F.count("*").alias("distinct"))
    root = [F.col(c).alias(f"root_{c}") for c in ("low", "high", "pages", "total")]
    whole = stage(
        tokens.filter((F.col("token") == ROOT) & (F.col("host") != "")).select(F.col("host").alias("h"), *root)
        .join(distinct, F.col("h") == F.col("h2")).drop("h2"), "hosts",
    )
    same = F.lit(True)
    for c in ("low", "high", "pages", "total"):
        same &= F.col(c) == F.col(f"root_{c}")
    telling = tokens.join(whole, F.col("host") == F.col("h")).filter(F.when(F.col("key").isNull(), same).otherwise(F.col("pages") * RARE >= F.col("root_pages")))
    return telling.select(*TOKENS.names, "distinct").groupBy("host").applyInArrow(_templates, TEMPLATE)


def main_text(source: str, template: dict | None) -> str:
    """Blocks of the main slot, one per line, without the slots that are judged to show none of the article.

    Slots that the host's template does not know are judged on the page alone. A page without a template, or without its main slot, is
    a template of its own.
    """
    page = Page(source)
    seen = page.totals()
    names = ("parent", "key", "total", "chars", "links", "before", "after")
    elements = {t: dict(zip(names, values, strict=True)) | {"token": t, "pages": 1, "low": values[2], "high": 0} for t, values in seen.items()}
    if template and template["main"] in seen:
        main, fixed = template["main"], set(template["fixed"] or ())
        order, below = _from_outside(elements)
        against = judge(elements, below)[0].difference(template["kept"] or ()).union(template["against"] or ())
    else:
        own = deduce(list(elements.values()), 1)
        main, fixed, against = own["main"] or ROOT, set(), set(own["against"])
    shown = [False] * len(page.nodes)
    for node, (token, around, _, _) in enumerate(page.nodes):
        shown[node] = token not in against and (token == main or around >= 0 and shown[around])
    return "\n".join(
        text for node, text, _, dropped in page.blocks
        if shown[node] and not dropped and not (fixed and _text_token(page.nodes[node][0], text) in fixed)
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars, n_classes`` per page row: the main text of the whole page.

    A null or empty page has an empty text. Pages without a host (null or odd addresses) get no template. Repeated rows stay
    repeated, other columns are ignored. Pages are joined with the small templates, never gathered by host.
    """
    ready(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), host.alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    known = stage(templates(rows.select("host", "html")), "templates").withColumnRenamed("host", "__host")
    joined = rows.join(known, F.col("host") == F.col("__host"), "left").select("__id", "__url", "html", "n_classes", "main", "against", "kept", "fixed")
    schema = T.StructType([
        T.StructField(id_col, rows.schema["__id"].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("n_classes", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 8)]
            known = [dict(zip(("main", "against", "kept", "fixed"), row, strict=True)) for row in zip(*columns[2:], strict=True)]
            texts = [main_text(source, template) for source, template in zip(columns[0], known, strict=True)]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts, batch.column(3)], names=schema.names)

    return joined.mapInArrow(run, schema)
