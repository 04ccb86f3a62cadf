"""Main text of web pages: containers are scored a page, their paths voted on a host, and the text taken by the winners."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm.batches import added, by_bytes, with_columns
from traceloom.llm.store import write_table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words of these that hardly ever name what holds an article: it is theirs only where the page has no other text.
SURE = frozenset("comment comments commentlist respond reply replies disqus cookie cookies consent gdpr newsletter breadcrumb breadcrumbs crumbs pagination pager adsense advertisement".split())
#: Elements that are no article text; a header inside an article is its heading and stays.
OUT = frozenset("head nav footer aside button select option datalist dialog menu svg canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: Words of class and id names that tell menus, headers, footers, sidebars, notices, adverts, forms and comments.
WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion promoted nav navbar navigation navi menu menubar breadcrumb breadcrumbs crumbs"
    " header masthead topbar footer foot bottombar sidebar side aside rail widget widgets cookie cookies consent gdpr notice notices banner alert disclaimer popup modal overlay"
    " newsletter subscribe subscription signup login form search searchbox comment comments commentlist respond reply replies disqus discussion share sharing social related"
    " recommended recommendations toolbar pagination pager skip".split()
)
CONTENT = frozenset("article main".split())
#: A page's article has this much text at least, where that of an element in doubt is held against it.
SOME = 80
#: Before or after such a word (no-sidebar, comments-open) a class name tells the layout or state of a page, not what its element is.
BEFORE, AFTER = frozenset("no not has have with without hide show is".split()), frozenset("open closed enabled disabled".split())
#: With such a word, a wrapper (content-sidebar-wrap) holds the article too, and a header (post-header) its heading.
OWN = frozenset("article content entry main post story".split())
WRAP = frozenset("wrap wrapper layout container".split())
#: Class names of elements that hold an article with its heading.
BODY = re.compile(r"\b(?:article|body|content|entry|main|post|story|text)\b")
#: An open element of the key ends where one of the values begins.
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "option": frozenset(["option"])}
CLOSES = {tag: [k for k, by in CLOSED_BY.items() if tag in by] for tag in BLOCK | {"option"}}
LEAVES = frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot table ul ol dl blockquote figure figcaption".split())
SCOPE = frozenset("table ul ol dl div article section main body aside nav footer header form blockquote td th".split())


@dataclass
class Node:
    tag: str
    path: str
    parent: Node | None
    out: bool
    inside: bool  # an article or main
    score: float = 0.0
    chars: int = 0
    link_chars: int = 0
    links: int = 0
    kept: int = 0
    hard: bool = False  # out by its tag or role, or below such an element
    soft: bool = False  # a form, or has a class or id word of WORDS
    sure: bool = False  # has one of SURE
    freed: bool = False  # holds the main element or most of the text
    name: str = ""  # tag and generalised classes
    holder: Node | None = None  # the block element at or above it
    case: Node | None = None  # the element at or above it that is no mere part of a text
    clean: int = 0  # characters that are no link, below no hard or soft element under it
    story: int = 0  # those of them in an element that is named as an article


@dataclass
class Page:
    every: list[Node] = field(default_factory=list)
    blocks: list[tuple[str, Node]] = field(default_factory=list)


def names(attributes: str) -> tuple[list[str], set[str], str]:
    """Generalised class names (digits as #), words of class and id, and role."""
    classes, words, role = [], set(), ""
    for name, *values in ATTRIBUTE.findall(attributes):
        value = unescape("".join(values))
        if name.lower() == "role":
            role = value.strip().lower()
            continue
        if name.lower() == "class":
            classes += [re.sub(r"\d+", "#", c) for c in value.lower().split()]
        for one in value.split():
            words |= told(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower()))
    return sorted(set(classes)), words, role


def told(name: list[str]) -> set[str]:
    """Words of one class or id name that tell what the element is."""
    if BEFORE & set(name[:-1]) or (name and name[-1] in AFTER) or (OWN & set(name) and WRAP & set(name)):
        return set()
    return set(name) - {"header"} if OWN & set(name) else set(name)


def settle(page: Page) -> None:
    """Decides what is out. Class words and forms are doubts, not proofs: an element in doubt stays where the elements of its
    name hold most of the page's text and little is left without them, so builders' containers, layouts and page-wide forms
    stay, while long comments beside an article go. Elements that hold main, or an article with most of the text, stay.
    If all text of the page would go, none does, and doubts only lower the score."""
    plain = sum(len(t) for t, n in page.blocks if not n.hard)
    for n in page.every:
        if n.tag == "main" or (n.tag == "article" and not n.soft and 2 * n.chars > plain):
            up = None if n.hard else n
            while up and not up.freed:
                up.freed, up = True, up.parent
    free(page)
    for n in page.every:
        n.out = n.hard or n.parent.out or (n.soft and not n.freed)
    if not kept_blocks(page):
        for n in page.every:
            n.soft = n.soft or n.parent.soft
            n.out = n.hard
    for t, n in kept_blocks(page):
        n.kept += len(t)
    for n in reversed(page.every):
        n.parent.kept += n.kept


def free(page: Page) -> None:
    """Frees elements in doubt, outer ones first, by what they hold and what is left without them."""
    if not any(n.soft and not n.freed and not n.hard for n in page.every):
        return
    root = page.every[0]
    while root.parent:
        root = root.parent
    whole: dict[int, int] = {}  # characters that are no link, of all below an element
    for t, n in page.blocks:
        if not n.hard:
            own = len(t) * (n.chars - n.link_chars) // max(1, n.chars)
            n.clean += own
            whole[id(n)] = whole.get(id(n), 0) + own
    for n in reversed(page.every):
        whole[id(n.parent)] = whole.get(id(n.parent), 0) + whole.get(id(n), 0)
        n.story = n.clean if n.tag in CONTENT or BODY.search(n.name) else n.story
        if not n.hard and (n.freed or not n.soft):
            n.parent.clean += n.clean
            n.parent.story += n.story
    total = whole.get(id(root), 0)
    held: dict[str, int] = {}  # by name, of the outermost elements of that name
    open_: dict[str, int] = {}
    way: list[Node] = []
    for n in page.every:
        while way and way[-1] is not n.parent:
            open_[way.pop().name] -= 1
        if not open_.get(n.name):
            held[n.name] = held.get(n.name, 0) + whole.get(id(n), 0)
        open_[n.name] = open_.get(n.name, 0) + 1
        way.append(n)
    # what lies outside of an element in doubt: its own page, and what the elements around it that were freed hold
    around: dict[int, tuple[int, int]] = {id(root): (root.clean, root.story)}
    shut: set[int] = set()
    for n in page.every:
        if n.hard or id(n.parent) in shut:
            shut.add(id(n))
            continue
        clean, story = around[id(n.parent)]
        around[id(n)] = (clean, story)
        if n.soft and not n.freed:
            left = clean > 0 if n.sure else story >= SOME or 4 * clean > total
            if 2 * held[n.name] > total and not left:
                n.freed = True
                around[id(n)] = (clean + n.clean, story + n.story)
            else:
                shut.add(id(n))


def parse(html: str) -> Page:
    """Blocks of text in page order, each with the element that holds it; markup, scripts and comments are gone."""
    page = Page()
    root = Node("", "", None, False, False)
    stack, text, linked, at = [root], [], [0], 0
    links = 0
    places: dict[str, list[int]] = {}  # of the open elements of a tag on the stack
    scopes = [0]

    root.holder = root.case = root

    def end_block() -> None:
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            node = stack[-1].holder
            page.blocks.append((block, node))
            node.chars += len(block)
            node.link_chars += min(linked[0], len(block))
        linked[0] = 0

    def close(i: int) -> None:
        nonlocal links
        while len(stack) > i:
            tag = stack.pop().tag
            places[tag].pop()
            links -= tag == "a"
            if tag in SCOPE:
                scopes.pop()

    while at < len(html):
        m = TOKEN.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece:
            decoded = unescape(piece)
            text.append(decoded)
            if links:
                linked[0] += len(decoded.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            end_block()
        if m[1]:
            if places.get(tag) and (tag in SCOPE or places[tag][-1] > scopes[-1]):
                close(places[tag][-1])
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = end.start() if end else len(html)
            stop = html.find(">", at)
            at = stop + 1 if end and stop >= 0 else len(html)
            continue
        if tag in VOID:
            text.append(" ")
            continue
        if tag in CLOSES:
            last = max((places[k][-1] for k in CLOSES[tag] if places.get(k)), default=0)
            if last and last >= scopes[-1]:
                close(last)
        up = stack[-1]
        classes, words, role = names(m[3]) if "=" in m[3] else ([], set(), "")
        inside = up.inside or tag in CONTENT or role in ("main", "article")
        hard = up.hard or tag in OUT or (tag == "header" and not up.inside) or role in ROLES
        soft = tag not in ("html", "body", "main") and (bool(words & WORDS) or tag == "form" or role == "form")
        out = up.out or hard or soft
        name = ".".join([tag, *classes])
        held = tag in BLOCK or out != up.out
        # a path is known by its hash: deep pages hold no long texts
        path = hashlib.blake2b(f"{up.holder.path}>{name}".encode(errors="surrogatepass"), digest_size=8).hexdigest() if held else up.path
        node = Node(tag, path, up, out, inside, name=name)
        node.holder = node if tag in BLOCK else up.holder
        node.case = up.case if tag in LEAVES else node
        node.hard, node.soft, node.sure = hard, soft, bool(words & SURE)
        page.every.append(node)
        if tag == "a":
            links += 1
            node.links = 1
        if not m[3].endswith("/") or tag in BLOCK:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
            if tag in SCOPE:
                scopes.append(len(stack) - 1)
    end_block()
    for n in reversed(page.every):  # children come after their parents
        n.parent.chars += n.chars
        n.parent.link_chars += n.link_chars
        n.parent.links += n.links
    settle(page)
    return page


def kept_blocks(page: Page) -> list[tuple[str, Node]]:
    return [(t, n) for t, n in page.blocks if not n.out]


def best_container(page: Page) -> tuple[str, float] | None:
    """Path and score of the element that holds most text: a block counts for its container, and half for the one above."""
    best = None
    for t, n in kept_blocks(page):
        own = n.case
        plain = len(t) * (1 - n.link_chars / max(1, n.chars)) * (0.1 if n.soft and not n.freed else 1)
        for share in (1.0, 0.5):
            own.score += plain * share
            if best is None or own.score > best.score:
                best = own
            if not own.parent:
                break
            own = own.parent
    if best is None:
        return None
    up = best.parent
    while up and up.tag not in ("", "html", "body") and (up.kept <= 1.3 * best.kept or BODY.search(up.name)):
        if up.tag in BLOCK:
            best = up  # headings and lists beside the longest part
        up = up.parent
    up = best
    while up:  # an article holds all of its sections
        if up.tag == "article" and not up.out:
            best = up
        up = up.parent
    return best.path, best.score


def text_by(page: Page, paths: list[str]) -> str:
    """Text of the elements of the first of these paths that has any, else all text that is not out."""
    kept = kept_blocks(page)
    own = {n.path for n in page.every}
    for path in paths:
        if path in own:
            under = below(page, path)
            found = [t for t, n in kept if under.get(id(n))]
            if found:
                return "\n".join(found)
    return "\n".join(t for t, _ in kept)


def is_menu(n: Node) -> bool:
    return n.tag in ("ul", "ol", "div", "table") and not n.inside and n.links > 1 and n.link_chars > 0.8 * n.chars


def below(page: Page, path: str) -> dict[int, bool]:
    """Which elements are at or below one of this path with no menu between, itself included; by their identity."""
    under: dict[int, bool] = {}
    for n in page.every:  # parents come first
        under[id(n)] = not is_menu(n) if n.path == path else under.get(id(n.parent), False) and not is_menu(n)
    return under


def own_paths(page: Page) -> list[str]:
    """Paths that have any text of the page."""
    found, lists = set(), {id(n) for _, n in kept_blocks(page)}
    for n in page.every:
        if id(n) in lists:
            up = n
            while up and up.tag and not is_menu(up) and (up.path, id(up)) not in found:
                found.add((up.path, id(up)))
                up = up.parent
    return sorted({p for p, _ in found})


def host_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", winners: int = 16, broadcast_bytes: int = 32 << 20, salts: int = 32, batch_bytes: int = 8 << 20) -> DataFrame:
    """Appends text and n_chars: the main text of each whole page.

    First pass: each page's best container gives a vote, weighted by its score's square root, to its path of
    tags and classes (digits as #) at its host; votes are summed in Spark before any shuffle. Second pass: of the
    host's paths that have text on the page, that of most votes wins; a page with none uses its own best container.
    Paths of hosts with at most `winners` of them come to each page as a list, broadcast if measured at under
    `broadcast_bytes`, else joined by host and one of `salts` salts, as a host can have any share of the pages. Pages of
    hosts with more paths meet the votes by host and path, and their winner by the page's hash: no path is left out.
    Null or empty html gives an empty text and 0; null urls form one host. Rows stay as they are.
    """
    base = pages.withColumn("__host", host_of(url))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "html", batch_bytes):
                best = [best_container(parse(h)) if h else None for h in batch.column("html").to_pylist()]
                made = [batch.column("host"), pa.array([b and b[0] for b in best], pa.string()), pa.array([b[1] ** 0.5 if b else None for b in best], pa.float64())]
                yield pa.RecordBatch.from_arrays(made, names=["host", "path", "score"])

    votes = base.select(F.col("__host").alias("host"), F.col(html).alias("html")).mapInArrow(score, "host string, path string, score double")
    votes = write_table(votes.where("path IS NOT NULL").groupBy("host", "path").agg(F.round(F.sum("score"), 3).alias("votes")), "host-votes")
    many = write_table(votes.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > winners).select(F.col("host").alias("__host")), "wide-hosts")
    paths = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))), lambda x: x["path"]).alias("__paths")
    few = votes.withColumnRenamed("host", "__host").join(many, "__host", "left_anti")
    chosen = write_table(few.groupBy("__host").agg(paths), "host-paths")
    held = chosen.agg(F.coalesce(F.sum(F.length("__host") + F.length(F.concat_ws("", "__paths")) + 64), F.lit(0))).first()[0]
    wide = not many.isEmpty()
    plain = base.join(many, "__host", "left_anti") if wide else base
    if held <= broadcast_bytes:
        joined = plain.join(F.broadcast(chosen), "__host", "left")
    else:
        salted = chosen.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = plain.withColumn("__salt", F.pmod(F.xxhash64(html, url), F.lit(salts)).cast("int")).join(salted, ["__host", "__salt"], "left")
    joined = joined.select(*pages.columns, "__paths")
    if wide:
        rest = base.join(many, "__host", "left_semi").withColumn("__page", F.xxhash64(html))

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in by_bytes(whole, "html", batch_bytes):
                    found = [own_paths(parse(h or "")) for h in batch.column("html").to_pylist()]
                    row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                    yield pa.RecordBatch.from_arrays([batch.column("host").take(row), batch.column("page").take(row), pa.array([p for f in found for p in f], pa.string())], names=["host", "page", "path"])

        named = rest.select(F.col("__host").alias("host"), F.col("__page").alias("page"), F.col(html).alias("html")).mapInArrow(name, "host string, page long, path string").distinct()
        won = named.join(votes, ["host", "path"]).groupBy(F.col("host").alias("__host"), F.col("page").alias("__page")).agg(F.array(F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"]).alias("__paths"))
        joined = joined.unionByName(rest.join(won, ["__host", "__page"], "left").select(*pages.columns, "__paths"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, html, batch_bytes):
                texts = []
                for h, tried in zip(batch.column(html).to_pylist(), batch.column("__paths").to_pylist(), strict=True):
                    page = parse(h or "")
                    own = best_container(page)
                    texts.append(text_by(page, [*(tried or []), *([own[0]] if own else [])]))
                yield with_columns(batch.select([c for c in batch.schema.names if c != "__paths"]), {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return joined.mapInArrow(extract, added(pages, [("text", T.StringType()), ("n_chars", T.LongType())]))


def op7_html(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")
