"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of each host.

A page is a stream of tags and texts. A host's wrapper is grown by aligning page after page with it: elements are matched
by signature (tag, classes, id) under matched parents. An element that some page lacks becomes optional, ``(x)?``; one
met several times in a row becomes repeated, ``(x)+``; where pages disagree on the order, the elements of that parent become one
repeated group of optional ones, ``(a? b?)+``; texts that differ become slots, ``#``. There are no unions. Alignment is
a merge of two such expressions, so every task grows wrappers from its own pages and hosts' few partial wrappers are
merged after: a host with a third of all pages is one row for each task.

The wrapper tells where the article is: among its subtrees outside boilerplate (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) the ``article`` with most text in slots, else ``main``, else an element named as
content. Where none of these has text in slots, the one with most text of the highest rank is taken, or the whole body if it has more text in slots
than that one has text. Only a host that has no such element loses texts that never change: those met three times or more,
on pages that differ, and always the same as a whole. Pages of the host are cut accordingly; a page without that place is wrapped by itself.

Inside the article the wrapper tells template from text, too. Elements that HTML itself marks as boilerplate (``nav``, ``aside``, ``form``,
roles, hidden ones) go. An element whose name only says so (a class of nothing but such words: ``ad-slot``) goes, unless the word is a doubtful one (``widget``, but not ``comments``) and it
holds half of what varies in the article or more. One whose name also says something else (``share-price``) stays, unless its text never changes. So does
any other, unless its own text, if it isn't a heading, is the same on all pages, ``FIXED`` pages of different text at least. A page by itself shows nothing
that never changes, so there names decide alone.

Blocks are joined by one newline; white space in a block is one space, which a line break counts as; character references are decoded once.

Defined cases: null html gives an empty text, as does a page of boilerplate; a null url belongs to the host of the empty name; truncated pages are
read as far as they go; nesting beyond ``DEPTH`` is flattened in wrappers, but for articles in it, and read like any other; repeated rows are rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Levels of a wrapper. Deeper elements are part of the one above, unless they rank higher as an article than all around them.
DEPTH = 48
#: Hosts whose wrappers a task holds at once, and elements that a host's wrapper tells apart under a parent, at most (beyond that, see ``fold``).
HOSTS, KINDS = 2000, 64
#: Pages of different text on which a text in an article is the same, for it to be template.
FIXED = 8
#: Stands in signatures for names not told apart; names are in lower case.
OTHER = "ANY"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")

# Element names and words of the HTML standard and of common page markup.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object canvas audio video title textarea select option button head".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
NOISE_TAGS = set("nav aside form footer menu dialog fieldset".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer copyright comment comments commentlist disqus reply replies respond "
    "related recommended recommendations share sharing social subscribe newsletter login signup search widget pagination pager toolbar".split()
)
DOUBTFUL_WORDS = set("banner modal notice notices overlay promo promotion search share sharing social toolbar widget".split())
NEUTRAL_WORDS = set(
    "area bar block body bottom box button buttons col column container content fixed float foot form global group head header holder home inline inner item items js label left "
    "layout link links list main mobile mod module outer page panel part posts primary right row secondary section site slot small sticky text title top unit view wrap wrapper zone".split()
)
CONTENT_WORDS = set("article content post entry story main".split())
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
HOLDS_ITEMS = set("ul ol dl table tbody thead tfoot".split())


def named_noise(names: str) -> int:
    """What classes and ids say: 2 if one is of nothing but boilerplate's words, 1 if one has such a word among others, 0 if none has."""
    found = 0
    for name in names.split():
        words = set(_WORD.findall(name))
        if not words.isdisjoint(NOISE_WORDS):
            found = max(found, 2 if words <= NOISE_WORDS | NEUTRAL_WORDS else 1)
    return found


class Element:
    __slots__ = ("kept", "level", "named", "noise", "rank", "sig", "soft", "source", "tag", "words")

    def __init__(self, tag: str, attrs: str, inside_article: bool):
        values = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTR.finditer(attrs)} if attrs.strip() else {}
        names = " ".join(values.get(k, "") for k in ("class", "id")).lower()
        words = set(_WORD.findall(names))
        self.source = self.tag = tag  # a role changes the latter
        self.words = words
        self.sig = ".".join([tag, *sorted(re.sub(r"\d+", "0", names).split())])
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
        head = not inside_article and (tag == "header" or not words.isdisjoint(("header", "masthead")))
        self.noise = tag in RAW or tag in NOISE_TAGS or hidden or head or values.get("role") in NOISE_ROLES
        self.named = 0 if words.isdisjoint(NOISE_WORDS) or tag in ("body", "html", "article", "main") else named_noise(names)
        if values.get("role") == "main":
            self.tag = "main"

    def put_under(self, above: Element | None, around: list[Element]) -> None:
        """Set what depends on the open elements: ``noise`` and ``soft``, noise by names, hold for all inside, ``kept`` says whether wrappers have a node for it, ``level`` how many do down to here."""
        level = above.level if above else 0
        self.noise = self.noise or bool(above and above.noise)
        self.soft = self.noise or self.named == 2 or bool(above and above.soft)
        self.kept, self.rank = level < DEPTH, 0  # the highest rank down to here, known beyond DEPTH only
        if not self.kept:
            highest = above.rank if len(around) > DEPTH else max(_rank(x.sig) for x in around)
            own = 0 if self.soft else _rank(self.sig)
            self.kept, self.rank = own > highest, max(own, highest)
        self.level = level + self.kept


def events(html: str) -> Iterator[tuple]:
    """("open", Element), ("close",), ("text", decoded text), ("break",): a well-formed stream of block elements, whatever the page's tags are like."""
    stack: list[Element] = []
    places: dict[str, list[int]] = defaultdict(list)  # tag: where in the stack it is

    def innermost(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def pop() -> None:
        places[stack.pop().source].pop()

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        end = m.start() if m else size
        if end > at:
            yield "text", entities.unescape(html[at:end])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>")
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if tag in RAW and tag != "head" and not closing:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = stop.end() if stop else size
            yield ("break",)
        elif tag in INLINE:
            if tag == "br":
                yield "text", " "
        elif closing:
            k = innermost({tag})
            if k < 0:
                yield ("break",)
            while len(stack) > k >= 0:
                pop()
                yield ("close",)
        elif tag in VOID:
            yield ("break",)
        else:
            if stack and stack[-1].tag in CLOSED_BY_BLOCK:
                pop()
                yield ("close",)
            if tag in CLOSED_BY_SAME and (k := innermost(CLOSED_BY_SAME[tag])) > innermost(HOLDS_ITEMS):
                while len(stack) > k:
                    pop()
                    yield ("close",)
            e = Element(tag, m[3], bool(places["article"]))
            e.put_under(stack[-1] if stack else None, stack)
            places[tag].append(len(stack))
            stack.append(e)
            yield "open", e
    for _ in stack:
        yield ("close",)


# A wrapper node: [{page: times its text was met there}, text (None, the key of a text that is always the same, or 0 for a slot), characters of text, order conflict, {signature: [least, most, node]}]
SLOT = 0
#: A text that never changes, on a host without an article, is one if it was met so often.
MET = 3


def new_node() -> list:
    return [{}, None, 0, False, {}]


def text_key(text: str) -> str:
    """A short text itself; of a longer one its beginning and a digest of the whole, which is never a short text."""
    return text if len(text) <= 80 else f"{text[:48]}…{xxhash.xxh3_128_hexdigest(text)}"


def page_wrapper(html: str, kinds: float = KINDS) -> list:
    """The wrapper of one page: its own element tree, with runs of equal elements folded."""
    root = new_node()
    page = ""  # its name is known at the end
    told = xxhash.xxh3_64()
    path = [(root, [], [])]  # node, its texts, signatures in order
    stack: list[Element] = []
    for ev in events(html):
        if ev[0] == "open":
            stack.append(ev[1])
            if ev[1].kept:
                node = new_node()
                path[-1][2].append((ev[1].sig, node))
                path.append((node, [], []))
        elif ev[0] == "close":
            if stack.pop().kept:
                _finish(page, kinds, *path.pop())
        elif ev[0] == "text" and ev[1].strip():
            if not (stack and stack[-1].noise):
                told.update(ev[1])
            if not (stack and stack[-1].soft and not stack[-1].kept):
                path[-1][1].append(ev[1])
    while path:
        _finish(page, kinds, *path.pop())
    _sign(root, told.hexdigest())  # pages of equal text are one, whatever is around it
    return root


def _sign(node: list, page: str) -> None:
    if node[0]:
        node[0] = {page: node[0][""]}
    for part in node[4].values():
        _sign(part[2], page)


def _finish(page: str, kinds: float, node: list, texts: list[str], kids: list[tuple[str, list]]) -> None:
    text = " ".join(" ".join(texts).split())
    if text:
        node[0], node[1], node[2] = {page: 1}, text_key(text), len(text)
    last = None
    counts: dict[str, int] = {}
    for sig, kid in kids:
        if sig not in node[4] and len(node[4]) >= kinds:
            sig = fold(sig)
        if sig in node[4]:
            node[3] |= sig != last  # met again after others
            align(node[4][sig][2], kid, kinds, True)
        else:
            node[4][sig] = [0, 0, kid]
        counts[sig] = counts.get(sig, 0) + 1
        last = sig
    for sig, n in counts.items():
        node[4][sig][:2] = [n, n]


def align(a: list, b: list, kinds: float = KINDS, same_page: bool = False) -> None:
    """Merge expression ``b`` into ``a``. Times met add up within a page, but a page given again adds none."""
    for page, n in b[0].items():
        if page in a[0]:
            a[0][page] = a[0][page] + n if same_page else max(a[0][page], n)
        elif len(a[0]) < FIXED:
            a[0][page] = n
    a[1] = b[1] if a[1] is None else a[1] if b[1] in (None, a[1]) else SLOT
    a[2] += b[2]
    both = [s for s in a[4] if s in b[4]]
    a[3] |= b[3] or both != [s for s in b[4] if s in a[4]]
    for sig, part in a[4].items():
        if sig in b[4]:
            least, most, node = b[4][sig]
            part[0], part[1] = min(part[0], least), max(part[1], most)
            align(part[2], node, kinds, same_page)
        else:
            part[0] = 0
    for sig, (_, most, node) in b[4].items():
        if sig not in a[4]:
            short = sig if len(a[4]) < kinds else fold(sig)
            if short in a[4]:
                a[4][short][1] = max(a[4][short][1], most)
                align(a[4][short][2], node, kinds, same_page)
            else:
                a[4][short] = [0, most, node]


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression."""
    parts = [] if node[1] is None else ["#" if node[1] == SLOT else json.dumps(node[1], ensure_ascii=False)]
    for sig, (least, most, kid) in node[4].items():
        times = "" if (least, most) == (1, 1) else "?" if most == 1 else "+" if least else "*"
        parts.append(f"<{sig}>({expression(kid)}){times}")
    return f"({' '.join(parts)})+" if node[3] else " ".join(parts)


def never_changes(node: list) -> bool:
    return isinstance(node[1], str) and sum(node[0].values()) >= MET


def is_template(node: list) -> bool:
    """Stricter, for texts in an article: the same on ``FIXED`` pages of different text."""
    return isinstance(node[1], str) and len(node[0]) >= FIXED


def _rank(sig: str) -> int:
    tag, *names = sig.split(".")
    if tag == "article":
        return 3
    if tag == "main":
        return 2
    return int(tag in ("div", "section", "td") and not CONTENT_WORDS.isdisjoint(_WORD.findall(" ".join(names))))


def _is_noise(sig: str, inside_article: bool, named: bool = True) -> bool:
    tag, *names = sig.split(".")
    e = Element(tag, f' class="{" ".join(names)}"', inside_article)
    return e.noise or named and e.named == 2


@lru_cache(4096)
def fold(sig: str) -> str:
    """The signature of all elements with that tag that are alike as boilerplate and as articles."""
    tag, *names = sig.split(".")
    if OTHER in names:
        return sig
    alike = ["ad"] if _is_noise(sig, True) else ["header"] if _is_noise(sig, False) else ["content"] if _rank(sig) == 1 else []
    return ".".join([tag, OTHER, *alike])


def fits(step: str | list[str], sig: str) -> bool:
    """Whether an element is at a step of ``article_path``."""
    return sig == step if isinstance(step, str) else fold(sig) == step[0] and sig not in step[1:]


def article_place(wrapper: list) -> tuple[list[str | list[str]], set[str]]:
    """Signatures down to the article (none: the whole page), and the keys of texts to leave out. A folded signature is followed by those told apart from it."""
    best: tuple = ()
    fixed: set[str] = set()

    def walk(node: list, path: list[str | list[str]], rank: int, in_article: bool, in_noise: bool) -> tuple[int, int]:
        """Characters in slots and of all text under a node, without boilerplate."""
        nonlocal best
        slots, total = 0 if never_changes(node) else node[2], node[2]
        if never_changes(node):
            fixed.add(node[1])
        for sig, (_, _, kid) in node[4].items():
            noise = in_noise or _is_noise(sig, in_article)
            step = [sig, *sorted(s for s in node[4] if OTHER not in s)] if OTHER in sig else sig
            found = walk(kid, [*path, step], _rank(sig), in_article or sig.split(".")[0] == "article", noise)
            if not noise:
                slots, total = slots + found[0], total + found[1]
        if rank and total and not in_noise:
            best = max(best, (slots > 0, rank, slots, total, -len(path), path), key=lambda x: x[:5])
        return slots, total

    slots, _ = walk(wrapper, [], 0, False, False)
    if not best:
        return [], fixed
    return ([] if not best[0] and slots > best[3] else best[5]), set()


def _doubtful(sig: str) -> bool:
    """Whether all words for boilerplate in the names may mean something else."""
    return NOISE_WORDS.intersection(_WORD.findall(" ".join(sig.split(".")[1:]))) <= DOUBTFUL_WORDS


def _weigh(node: list) -> tuple[int, int]:
    """Characters in slots, and of all text, in a part of the article; undoubted boilerplate doesn't count."""
    slots, total = 0 if is_template(node) else node[2], node[2]
    for sig, (_, _, kid) in node[4].items():
        if not _is_noise(sig, True, not _doubtful(sig)):
            s, t = _weigh(kid)
            slots, total = slots + s, total + t
    return slots, total


#: What a wrapper says of an element in an article: it stays, it goes, its own text goes.
STAYS, GOES, OWN_GOES = 1, 2, 4


def parts_told(node: list, whole: int) -> dict[str, list]:
    """{signature: [what the wrapper says against names, the same for its parts]}, where it says anything."""
    told = {}
    for sig, (_, _, kid) in node[4].items():
        if _is_noise(sig, True, False):
            continue
        tag, *names = sig.split(".")
        named = named_noise(" ".join(names)) if OTHER not in names else 2 if _is_noise(sig, True) else 0
        slots, total = _weigh(kid)
        says = 0
        if named == 2 and whole and 2 * slots >= whole and _doubtful(sig):
            says = STAYS
        elif named == 1 and total and not slots:
            says = GOES
        if is_template(kid) and tag not in HEADINGS:
            says |= OWN_GOES
        inside = parts_told(kid, whole)
        if says or inside:
            told[sig] = [says, inside]
    return told


def article_parts(wrapper: list, path: list[str | list[str]]) -> dict[str, list]:
    node = wrapper
    for step in path:
        node = node[4][step if isinstance(step, str) else step[0]][2]
    whole = _weigh(node)[0]
    return parts_told(node, whole) if path and whole else {}


def article_path(wrapper: list) -> list[str | list[str]]:
    """Signatures down to the article; empty: the whole page."""
    return article_place(wrapper)[0]


def cut(html: str, path: list[str | list[str]], fixed: set[str], parts: dict[str, list] | None = None) -> str | None:
    """The text of the article at ``path``; None if the page has no such place. ``parts``: see ``parts_told``."""
    blocks: list[str] = []
    run: list[str] = []
    top = (False, not path, True, parts or {}, 0)
    stack: list[tuple[bool, bool, bool, dict, int]] = []  # whether inside noise, inside the article, on the path to it; what is told of parts, and of this one
    met = not path

    def end_block() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text and text_key(text) not in fixed:
            blocks.append(text)

    for ev in events(html):
        if ev[0] == "text":
            noise, inside, _, _, says = stack[-1] if stack else top
            if inside and not noise and not says & OWN_GOES:
                run.append(ev[1])
            continue
        if ev[0] == "open":
            e = ev[1]
            noise, inside, on_path, told, says = stack[-1] if stack else top
            if e.kept:
                says = 0
                if inside:
                    says, told = told.get(e.sig) or told.get(fold(e.sig)) or (0, {})
                on_path = on_path and e.level <= len(path) and fits(path[e.level - 1], e.sig)
            noise = noise or e.noise or bool(says & GOES) or (e.named == 2 and not says & STAYS)
            if e.kept and on_path and not inside and not noise and e.level == len(path):
                inside = met = True
            end_block()
            stack.append((noise, inside, on_path, told, says))
        elif ev[0] == "close":
            end_block()
            stack.pop()
        else:
            end_block()
    end_block()
    return "\n".join(blocks) if met else None


def extract(html: str | None, path: list[str | list[str]], fixed: set[str], parts: dict[str, list] | None = None) -> str:
    if not html:
        return ""
    text = cut(html, path, set() if path else fixed, parts)
    if text is None:  # not built like its host's other pages
        text = cut(html, article_path(page_wrapper(html, math.inf)), set())
    return text or ""


def _host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"://([^/?#]*)", 1))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from (host, html)."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                wrapper = page_wrapper(page.as_py() or "")
                if host in held:
                    align(held[host], wrapper)
                else:
                    held[host] = wrapper
            if len(held) > HOSTS:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, node = None, None
        for b in batches:
            done: dict[str, list] = {}
            for h, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h == host and node is not None:
                    align(node, json.loads(w))
                else:
                    if node is not None:
                        done[host] = node
                    host, node = h, json.loads(w)
            yield out(done)
        if node is not None:
            yield out({host: node})

    partial = pages.select("host", "html").mapInArrow(grow, "host string, wrapper string")
    return partial.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merge, "host string, wrapper string")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", _host())
    wrappers = materialize(infer_wrappers(rows), "page-wrappers")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ways = [json.loads(w) for w in b.column(1).to_pylist()]
            found = [json.dumps([path, sorted(fixed), article_parts(way, path)]) for way in ways for path, fixed in [article_place(way)]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["host", "place"])

    places = materialize(wrappers.mapInArrow(place, "host string, place string"), "page-places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list, set[str], dict]] = {}
        for b in batches:
            texts = []
            for page, where in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                if where not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    path, fixed, parts = json.loads(where) if where else ([], [], {})
                    known[where] = (path, set(fixed), parts)
                texts.append(extract(page.as_py(), *known[where]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    joined = rows.join(places, "host", "left").select("id", "url", "html", "place")
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
