"""Main text of web pages by template deduction over the pages of a host.

Tokens are opening tags with their path and runs of text with theirs.  Over
all pages of a host, tokens with the same occurrence vector (so many times on
each page) form an equivalence class; classes that are frequent, have several
tokens and keep their order make up the host's template.  Classes
nest in each other's slots.  What the template leaves is main text or not by
the elements that hold it: menus, notices, comments and the like go, and of
article elements, main elements and elements named like them those with the
most text stay; on pages without any of these all the rest counts.

Pages also share text that is their own: revisions, near copies, refrains.  So
shared text is the frame's only where it surrounds what differs; among or
between a page's own text, and in elements named like articles, many different pages must have it
too.  A page of which most would go is a copy of others and keeps its text.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTable, bound_batches, join_unique

#: A class is frequent if at least this share of a host's pages, and two of them, hold it.
SUPPORT, LEAST_TOKENS = 0.5, 2
#: Different pages that must share a text among a page's own text, their share of all, and what the frame may take of a page at most.
MANY, NEARLY_ALL, LARGEST_FRAME = 5, 0.9, 2 / 3
#: Hosts with more than one in so many of all pages have their templates broadcast; there are at most so many of them.
HOT_HOSTS = 1000

# Elements and the words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements that hold a line or paragraph and not a part of the page.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre figcaption caption summary".split())
OUTSIDE = RAW | frozenset("head nav header footer aside form button select option label fieldset menu dialog object canvas audio video map".split())
MAIN = {"article": 3, "main": 2}
OUTSIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside widget cookie cookies consent gdpr notice notices alert comment comments respond reply replies disqus discussion share sharing social related recommended newsletter subscribe subscription signup login search form pagination pager toolbar skip contentinfo complementary".split())
#: A class with one of these names what a page's frame has, not what the element is.
FRAME_WORDS = frozenset("has with without no layout wrap wrapper container page site body template row col grid".split())
MAIN_WORDS = frozenset("article main content post entry story body-text articlebody maincontent".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an unclosed one of CLOSES isn't looked for beyond.
SCOPES = frozenset("ul ol dl table div section article main body nav aside footer header form blockquote".split())

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+'|['\"])*+)>", re.DOTALL)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z][a-z0-9]*")
_SPACE = re.compile(r"\s+")


class Run:
    """A run of text: the hash of its path, the block it stands in, whether its elements are outside the article, how surely inside (3 to 0), and the part of the page."""

    __slots__ = ("text", "path", "block", "outside", "main", "part")

    def __init__(self, text, path, block, outside, main, part):
        self.text, self.path, self.block, self.outside, self.main, self.part = text, path, block, outside, main, part


def parse(page: str | None) -> list:
    """Opening tags (as hashes of their paths) and runs of text (as Run), in page order."""
    page, out, stack, at, block, parts = page or "", [], [("", 0, False, 0, 0)], 0, 0, 0

    def text(start, end):
        if start < end and not (raw := page[start:end]).isspace():
            _, path, outside, main, part = stack[-1]
            out.append(Run(references.unescape(raw), path, block, outside, main, part))

    pos = 0
    while found := _PIECE.search(page, pos):
        text(at, found.start())
        at = pos = found.end()
        closing, name, attributes = found.groups()
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            block += 1
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in CLOSES.get(name, ()):
                del stack[i:]
                break
            if stack[i][0] in SCOPES:
                break
        named = " ".join("".join(x) for x in _NAMED.findall(attributes)).lower() if "=" in attributes else ""
        own = f"{name}.{'.'.join(sorted(set(named.split())))}" if named else name
        _, path, outside, main, part = stack[-1]
        said = [] if name in ("html", "body") else [w for w in (set(_WORDS.findall(c)) for c in named.split()) if not w & FRAME_WORDS]
        # A class that says article outweighs another that may mean a frame: class="story share-price".
        outside = outside or name in OUTSIDE or (any(w & OUTSIDE_WORDS for w in said) and not any(w & MAIN_WORDS and not w & OUTSIDE_WORDS for w in said))
        main = max(main, MAIN.get(name, 0), 1 if any(w & MAIN_WORDS for w in said) else 0)
        path = xxhash.xxh64_intdigest(own.encode("utf-8", "surrogatepass"), path)
        out.append(path)
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>|\Z", re.IGNORECASE).search(page, pos)
            at = pos = end.end()
            continue
        if name not in LINES and name not in INLINE:
            part = parts = parts + 1
        stack.append((name, path, outside, main, part))
    text(at, len(page))
    return out


def token(piece) -> int:
    """A signed 64-bit token of a tag's path, or of a run's path and text."""
    if isinstance(piece, int):
        return piece - (1 << 63)
    return xxhash.xxh64_intdigest(f"|{_SPACE.sub(' ', piece.text).strip()}".encode("utf-8", "surrogatepass"), piece.path) - (1 << 63)


def valid_classes(tokens: list[int], classes: dict[int, int]) -> set[int]:
    """Tokens of the page that stand in a valid class: the class's tokens follow each other in one order, again and again."""
    sizes = Counter(classes.values())
    seen: dict[int, list[int]] = defaultdict(list)
    for t in tokens:
        if t in classes:
            seen[classes[t]].append(t)
    good = set()
    for c, order in seen.items():
        own = list(dict.fromkeys(order))
        if sizes[c] >= LEAST_TOKENS and len(order) % len(own) == 0 and order == own * (len(order) // len(own)):
            good.update(own)
    return good


def nested_template(tokens: list[int], classes: dict[int, int]) -> tuple[set[int], list[tuple[int, int] | None]]:
    """Tokens of the valid classes that nest, and by token the slot it stands in: a class and how many of its tokens came before.

    An instance of a class reaches from its first token to its last.  Classes
    nest if each instance stands in one slot of another class, the same for
    all instances; of two that overlap otherwise, the one with fewer tokens goes.
    """
    good = valid_classes(tokens, classes)
    sizes = Counter(classes[t] for t in good)
    bad = {0}
    while bad:
        stack, parents, slots, bad = [], {}, [], set()
        for t in tokens:
            if t not in good:
                slots.append(tuple(stack[-1]) if stack else None)
                continue
            c = classes[t]
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == c), None)
            if at is None:
                slots.append(tuple(stack[-1]) if stack else None)
                if parents.setdefault(c, slots[-1]) != slots[-1]:
                    bad.add(c)
                stack.append([c, 0])
                at = len(stack) - 1
            else:
                slots.append(tuple(stack[at]))
            if at < len(stack) - 1:
                bad.add(min((x[0] for x in stack[at:]), key=lambda x: (sizes[x], x)))
                del stack[at + 1 :]
            stack[at][1] += 1
            if stack[at][1] == sizes[c]:
                stack.pop()
        good = {t for t in good if classes[t] not in bad}
    return good, slots


def without_frame(runs: list[tuple[Run, tuple | None, bool, bool]]) -> list[tuple[Run, tuple | None]]:
    """The (run, slot) that aren't frame, of all runs (run, slot, whether the template has it, whether nearly all of many pages do).

    Template text that few pages share goes where its part of the page has none
    of the page's own text and lies before or after all of that; in elements
    named like articles, and among own text, only text of many pages goes.
    """
    own = [i for i, (r, _, shared, _) in enumerate(runs) if not shared and not r.outside]
    if not own:
        return [x[:2] for x in runs]
    parts, inside = {runs[i][0].part for i in own}, any(r.main > 1 and not r.outside for r, *_ in runs)
    left, gone, all_text = [], 0, 0
    for i, (r, slot, shared, many) in enumerate(runs):
        among = r.main > 0 if inside else r.part in parts or own[0] < i < own[-1]
        goes = shared and (many or not among)
        all_text += 0 if r.outside else len(r.text)
        gone += len(r.text) if goes and not r.outside and (among or not inside) else 0
        if not goes:
            left.append((r, slot))
    return left if gone <= LARGEST_FRAME * all_text else [x[:2] for x in runs]


def main_text(page: str | None, classes: dict[int, int] | None = None, many: frozenset[int] = frozenset()) -> str:
    """Main text of a page, given the classes of its host's frequent tokens and those tokens that nearly all of many pages have.

    The template's own text goes first.  Of the slots that are left, elements
    tell which hold main text: those of the kind (article, main and, where
    there is a template, a name like these) with the most text.
    """
    pieces = parse(page)
    runs = [(p, None) for p in pieces if isinstance(p, Run)]
    if classes:
        tokens = [token(p) for p in pieces]
        template, slots = nested_template(tokens, classes)
        runs = without_frame([(p, s, t in template, t in many) for p, t, s in zip(pieces, tokens, slots) if isinstance(p, Run)])
    runs = [(r, s) for r, s in runs if not r.outside]
    # A slot is of the kind that most of its text has.
    held: dict = defaultdict(Counter)
    for r, s in runs:
        held[s if classes else r.main][r.main] += len(r.text)
    kinds: Counter = Counter()
    for own in held.values():
        kinds[max(own, key=lambda k: (own[k], k))] += sum(own.values())
    compete = {3, 2, 1} if classes else {3, 2}
    surest = max((k for k in kinds if k in compete), key=lambda k: (kinds[k], k), default=max(kinds, default=0))
    chosen = [r for r, _ in runs if r.main == surest]
    out, last = [], None
    for run in chosen:
        out.append(run.text if run.block == last else f" {run.text}")
        last = run.block
    return _SPACE.sub(" ", "".join(out)).strip()


def host_column(url):
    """Host of a URL column: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def host_templates(pages: DataFrame, support: float = SUPPORT, url: str = "url", html: str = "html") -> DataFrame:
    """(host, n, tokens) of every host: its rows, and its frequent tokens, each with its class and whether nearly all of many pages have it; null where it has one page only.

    Pages with the same HTML count once.  A class is named by its occurrence vector's hash.  A host has at most
    1/support times as many frequent tokens as its pages have on average.
    """

    def emit(batches):
        for batch in batches:
            found = [Counter(token(p) for p in parse(page.as_py())) for page in batch.column(2)]
            tokens, times = pa.array([list(f) for f in found], pa.list_(pa.int64())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens, times], ["host", "key", "tokens", "times"])

    keyed = pages.select(host_column(F.col(url)).alias("host"), F.xxhash64(html).alias("key"), F.col(html).alias("html"))
    rows = keyed.mapInArrow(emit, "host string, key long, tokens array<long>, times array<int>")
    # A page is one row until its copies are gone; a row for each token would double what is shuffled.
    each = rows.dropDuplicates(["host", "key"]).select("host", "key", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("times").alias("n"))))
    counts = each.groupBy("host", "token").agg(F.count("*").alias("on"), F.bit_xor(F.xxhash64("key", "n")).alias("class")).where("on > 1")
    hosts = keyed.groupBy("host", "key").agg(F.count("*").alias("n")).groupBy("host").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))
    frequent = counts.join(hosts.select("host", "pages"), "host").where(F.col("on") >= support * F.col("pages"))
    frequent = frequent.withColumn("many", (F.col("on") >= MANY) & (F.col("on") >= NEARLY_ALL * F.col("pages")))
    return hosts.select("host", "n").join(frequent.groupBy("host").agg(F.collect_list(F.struct("token", "class", "many")).alias("tokens")), "host", "left")


def extract_pages(pages: DataFrame, support: float = SUPPORT, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    A null page counts as empty and has empty text, as has a page without main
    text.  A null URL's pages form a host of their own; hosts of one page have
    no template.  Repeated rows stay, other columns are ignored.  Templates are
    written once; those of large hosts are broadcast to their pages, the pages
    of other hosts are shuffled to theirs.
    """
    bound_batches(pages.sparkSession)
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_column(F.col(url)).alias("host"))
    templates = SharedTable(host_templates(pages, support, url, html), "templates").df
    total = templates.agg(F.sum("n")).first()[0] or 0
    joined = join_unique(own, templates, "host", total, hot=HOT_HOSTS)

    def run(batches):
        known: dict = {}
        for batch in batches:
            texts = []
            for page, tokens, host in zip(batch.column(2), batch.column(3), batch.column(4)):
                if (found := known.get(host := host.as_py())) is None:
                    if len(known) >= 64:
                        known.pop(next(iter(known)))
                    rows = tokens.as_py() or ()
                    found = known[host] = ({t["token"]: t["class"] for t in rows}, frozenset(t["token"] for t in rows if t["many"]))
                texts.append(main_text(page.as_py(), *found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[page_id].dataType.simpleString()
    return joined.select("page_id", "url", "html", "tokens", "host").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
