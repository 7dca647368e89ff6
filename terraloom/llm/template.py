"""HTML extraction by equivalence-class template deduction.

Tokens of a page are its elements, each by its path of tags and classes, and
its blocks of text, each by path and wording. Across the pages of a host every
token has an occurrence vector: how often it stands on each page. Tokens of
equal vectors form an equivalence class. A class is valid if it is frequent
(``SHARE`` of the host's pages, ``PAGES`` at least) and holds an element; as
an element stands on no page without those it lies in, valid classes nest up
to the root. The valid classes, nested, are the host's template; what stands
between template tokens are slots.

Content slots are found on the template: from the root, the walk goes down
into the element that stands once a page and holds most of the text that
isn't links, as long as no heading stays behind. The element it ends at is the
host's content. Left out of it are: wording of the template, elements made of
links, and elements that by name are comments, adverts or the like, unless
they hold most of the text. Elements that by their tag never hold content
(scripts, menus, forms and so on) count nowhere. A page that its host's
template says nothing about is its own template.

Occurrence vectors are never built: a token's vector is known by two sums of
halves of hashes of (page, count), which Spark adds up with map-side combine.
So a host with a third of all pages isn't gathered anywhere; a host's template
is no longer than its pages.

Defined results: null or empty html gives an empty text; a host with fewer
than ``PAGES`` pages has no template; a null url is a host of its own;
repeated rows count as pages each, with equal results; wording is kept where
dropping it would leave less than half of the content (pages that are copies
of each other); what follows a tag that isn't closed before the page's end is
markup; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from terraloom.llm.common import store, tune

PAGES = 3
SHARE = 0.9

# HTML's elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot select div section article main body".split())
APART = frozenset("head nav footer aside form button select menu dialog svg math object canvas audio video map".split()) | RAW
CONTAINERS = frozenset("html body div section article main center table tbody tr td span".split())
HEADINGS = frozenset("h1 h2 h3".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in the name of a container that tell against it, if it doesn't hold most of the text.
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice notices banner popup modal newsletter subscribe share sharing social related recommended sidebar menu navbar nav navigation breadcrumb breadcrumbs comment comments disqus respond replies login signup search pager pagination widget footer".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_WORD = re.compile(r"[^a-z]+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass(slots=True)
class Node:
    """An element: its token, the element it lies in, what its tag and name say, and the text below it."""

    token: int
    up: int
    tag: str
    apart: bool  #: never content
    named: bool  #: a container whose name tells against it
    text: int = 0  #: characters below it that aren't links, but for those of named elements inside
    linked: int = 0


@dataclass(slots=True)
class Piece:
    node: int
    link: bool
    block: int
    text: str


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _tag(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes of a tag whose name ends at ``at``, whether it closes itself, and where it ends (-1: nowhere)."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        while at < n and page[at].isspace():
            at += 1
        if at >= n:
            return found, False, -1
        if page[at] == ">":
            return found, page[at - 1] == "/", at + 1
        m = _ATTRIBUTE.match(page, at)
        if not m:  # a lone slash or equals sign
            at += 1
            continue
        if m[2] is None and m[3] is None and m[4] is None and page[m.end() : m.end() + 1] in ('"', "'") and page[at : m.end()].rstrip().endswith("="):
            return found, False, -1  # a quote that isn't closed
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()


def parse(page: str) -> tuple[list[Node], list[Piece]]:
    """The elements of a page, the root first, and its pieces of text, in time linear in its length."""
    root = Node(0, -1, "", False, False)
    nodes, pieces = [root], []
    stack: list[tuple[int, bool]] = [(0, False)]  # element, in a link
    open_tags: Counter = Counter()
    block, at, n = 0, 0, len(page)

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            k, link = stack[-1]
            pieces.append(Piece(k, link, block, _html.unescape(raw)))
            if link:
                nodes[k].linked += len(raw)
            else:
                nodes[k].text += len(raw)
        elif raw and pieces and pieces[-1].block == block:
            pieces[-1].text += " "

    def close(down_to: int) -> None:
        for k, _ in stack[down_to:]:
            open_tags[nodes[k].tag] -= 1
        del stack[down_to:]

    def close_nearest(tags: set[str], stop: frozenset[str]) -> None:
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i][0]].tag
            if tag in tags:
                return close(i)
            if tag in stop:
                return None

    while at < n:
        lt = page.find("<", at)
        while lt >= 0 and not (page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] in ("/", "!", "?")):
            lt = page.find("<", lt + 1)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page[lt + 1] == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:  # a declaration, or what counts as a comment
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag = m[0].lower()
        attributes, empty, at = _tag(page, m.end())
        if at < 0:
            break
        if closing:
            if open_tags[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i][0]].tag == tag:
                        close(i)
                        break
            block += tag in BLOCKS
            continue
        if tag == "br":
            if pieces and pieces[-1].block == block:
                pieces[-1].text += " "
            continue
        block += tag in BLOCKS
        if tag in CLOSES_P:
            close_nearest({"p"}, HOLDERS)
        if tag in SIBLINGS:
            close_nearest(SIBLINGS[tag], HOLDERS)
        up, link = stack[-1]
        name = attributes.get("class", "").lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in APART_ROLES
        header = tag == "header" and not any(open_tags[t] for t in ("article", "main"))
        named = tag in CONTAINERS | {"ul", "ol", "header"} and not APART_NAMES.isdisjoint(_WORD.split(f"{name} {attributes.get('id', '').lower()}"))
        nodes.append(Node(_hash(str(nodes[up].token), tag, name), up, tag, nodes[up].apart or tag in APART or hidden or header, named))
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            if not end:
                break
            at = page.find(">", end.end()) + 1 or n
        elif tag not in VOID and not empty:
            stack.append((len(nodes) - 1, link or tag == "a"))
            open_tags[tag] += 1
    for node in reversed(nodes[1:]):  # what lies below comes later
        if not node.apart:
            nodes[node.up].text += 0 if node.named else node.text
            nodes[node.up].linked += 0 if node.named else node.linked
    return nodes, pieces


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _blocks(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces by the block they stand in, in page order."""
    out: dict[int, list[Piece]] = {}
    for p in pieces:
        out.setdefault(p.block, []).append(p)
    return list(out.values())


def host(url: str | None) -> str:
    if url is None:
        return ""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return (m[1] if m else url).lower()


@dataclass(slots=True)
class Token:
    """An element or a wording across the pages of a host."""

    token: int
    up: int
    tag: str  #: empty for wording
    apart: bool
    named: bool
    n: int  #: on a page
    text: int
    linked: int


def tokens(nodes: list[Node], pieces: list[Piece]) -> list[Token]:
    """The tokens of a page; the root is 0."""
    out: dict[int, Token] = {}
    for node in nodes:
        t = out.setdefault(node.token, Token(node.token, nodes[node.up].token if node.up >= 0 else 0, node.tag or "root", node.apart, node.named, 0, 0, 0))
        t.n, t.text, t.linked = t.n + 1, t.text + node.text, t.linked + node.linked
    for block in _blocks([p for p in pieces if not nodes[p.node].apart]):
        up = nodes[block[0].node].token
        t = out.setdefault(k := _hash(str(up), "text", _squeezed("".join(p.text for p in block))), Token(k, up, "", False, False, 0, 0, 0))
        t.n += 1
    return list(out.values())


@dataclass(slots=True)
class Template:
    """What a host's valid classes say: where content lies, what in it is none, and which wording is the host's."""

    content: int = 0
    dropped: set[int] = field(default_factory=set)
    wording: set[int] = field(default_factory=set)


def deduce(held: list[tuple[int, int, str, bool, bool, bool, int, int]], wording: set[int]) -> Template:
    """The template of (token, up, tag, apart, named, once a page, text, linked) of the elements in valid classes."""
    by = {h[0]: h for h in held}
    kids: dict[int, list[int]] = {}
    worded: set[int] = set()  # elements with wording of the template
    for token, up, tag, apart, *_ in held:
        if tag == "" and token in wording:
            worded.add(up)
        elif token and not apart and tag:
            kids.setdefault(up, []).append(token)
    if 0 not in by:
        return Template()

    def headed(token: int, seen: list[int] | None = None) -> bool:
        stack = [token]
        while stack:
            k = stack.pop()
            if by[k][2] in HEADINGS and k not in worded and by[k][6]:
                return True
            stack += [c for c in kids.get(k, []) if not by[c][4]]
        return False

    at = 0
    while True:
        below = [k for k in kids.get(at, []) if by[k][5] and by[k][2] in CONTAINERS]
        own = [k for k in below if not by[k][4]]
        mass = lambda k: by[k][6] * (2 if by[k][2] in ("article", "main") else 1)  # noqa: E731  those tags are a hint, no more
        best = max(own, key=lambda k: (mass(k), k), default=None)
        if best is None or not by[best][6]:  # only named ones hold text
            best = max(below, key=lambda k: (mass(k), k), default=None) if not by[at][6] else None
        if best is None or not by[best][6] or 2 * mass(best) < by[at][6]:
            break
        if any(k != best and headed(k) for k in kids.get(at, []) if not by[k][4]):
            break
        at = best
    out = Template(at, wording=wording)
    for token, _, tag, apart, named, _, text, linked in held:
        if tag and token != at and not apart and ((named and 2 * text < by[at][6]) or (linked > text and tag in CONTAINERS | {"ul", "ol", "dl", "p"} and 2 * linked < by[at][6] + by[at][7])):
            out.dropped.add(token)
    return out


def own_template(nodes: list[Node], pieces: list[Piece]) -> Template:
    """A page as its own template, wording apart."""
    return deduce([(t.token, t.up, t.tag, t.apart, t.named, t.n == 1, t.text, t.linked) for t in tokens(nodes, []) if t.tag], set())


def extract(page: str | None, template: Template | None = None) -> str:
    """The main text of a page by its host's template, or by its own."""
    nodes, pieces = parse(page or "")
    if template is None or not any(n.token == template.content and n.text for n in nodes):
        found = own_template(nodes, pieces)
        template = Template(found.content, found.dropped, template.wording if template else set())
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes):
        if node.token == template.content:
            inside[i] = True
        elif node.up >= 0 and inside[node.up]:
            # A named element that the template doesn't know, as it stands on few pages.
            inside[i] = not (node.apart or node.token in template.dropped or (node.named and node.tag != "header" and 2 * node.text < nodes[0].text))
    blocks = [(_hash(str(nodes[b[0].node].token), "text", w), w) for b in _blocks([p for p in pieces if inside[p.node]]) if (w := _squeezed("".join(p.text for p in b)))]
    left = [w for k, w in blocks if k not in template.wording]
    if 2 * sum(map(len, left)) < sum(len(w) for _, w in blocks):
        left = [w for _, w in blocks]
    return "\n\n".join(left)


TOKENS = "host string, token long, up long, tag string, apart boolean, named boolean, n long, text long, linked long, mark long"


def templates(pages: DataFrame) -> DataFrame:
    """host and held, the tokens of its valid classes, for hosts that have a template."""
    tune(pages.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                h, me = host(url), str(page_id)
                rows += [(h, t.token, t.up, t.tag, t.apart, t.named, t.n, t.text, t.linked, _hash(me, str(t.n))) for t in tokens(*parse(page or ""))]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 10, kinds)], names=[c.split()[0] for c in TOKENS.split(", ")])

    seen = pages.select("page_id", "url", "html").mapInArrow(run, TOKENS)
    low, high = F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("mark", 32)
    # Sums, as marks of repeated rows would cancel under exclusive or; flags and counts are hashed types, so nothing is sorted.
    per = seen.groupBy("host", "token").agg(
        F.max("up").alias("up"), F.sum(low).alias("v1"), F.sum(high).alias("v2"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("total"),
        F.max("apart").alias("apart"), F.max("named").alias("named"), F.sum("text").alias("text"), F.sum("linked").alias("linked"), F.max("tag").alias("tag"),
    )
    per = store(per.where(F.col("pages") >= PAGES), "html-tokens")
    hosts = per.where(F.col("token") == 0).select("host", F.col("pages").alias("of"))
    often = per.join(hosts, "host").where(F.col("pages") >= F.col("of") * SHARE)
    # An equivalence class: equal vectors. It is valid if an element is in it.
    vector = ["host", "v1", "v2", "pages", "total"]
    valid = often.where(F.col("tag") != "").select(*vector).distinct()
    held = often.join(valid, vector, "left_semi")
    once = F.col("total") == F.col("pages")
    return held.groupBy("host").agg(F.collect_list(F.struct("token", "up", "tag", "apart", "named", once.alias("once"), "text", "linked")).alias("held"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of ``pages`` (page_id, url, html)."""
    tune(pages.sparkSession)
    known = store(templates(pages), "html-templates")  # stored, so Spark knows its size before it sends it round

    def hosts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host(u) for u in batch.column(1).to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url", "html").schema.fields}
    rows = pages.select("page_id", "url", "html").mapInArrow(hosts, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", host string")
    rows = rows.join(known, "host", "left").select("page_id", "url", "html", "host", "held")

    def run(batches):
        made: dict[str, Template | None] = {}
        for batch in batches:
            texts = []
            held = batch.column(4)
            for i, (page, h) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if h not in made:
                    if len(made) > 10_000:
                        made.clear()
                    got = held[i].as_py()
                    made[h] = deduce([tuple(t.values()) for t in got], {t["token"] for t in got if not t["tag"]}) if got else None
                texts.append(extract(page, made[h]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
