"""Main text of web pages by consensus host paths.

Each page names the container that scores best, widened to the container that holds
the rest of the article, by its generalised tag-class path. The votes are added up per host, and each page is read again with the paths that won on its
host; a page that has none of them falls back to its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoralytics.llm.common import cut_lineage

#: A path wins on its host if it has this share of the votes, so a host has 20 winners at most.
SHARE = 0.05

#: Rows of winners that may be broadcast; beyond, pages are joined to them by host.
SMALL = 200_000

#: Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset(
    "nav header footer aside form script style noscript template iframe object svg math canvas audio video "
    "button select textarea input dialog menu head title noembed noframes xmp".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address hr details summary fieldset center hgroup".split()
)
CONTAINERS = frozenset("html body main article section div td center details blockquote".split())
#: An opening tag on the left ends open elements of the kinds on the right.
CLOSES = {
    **{t: frozenset(["p"]) for t in BLOCKS - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "li", "dt", "dd"}},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "tr", "td", "th"]),
    "option": frozenset(["option"]),
}
#: An implied end doesn't reach beyond these.
SCOPES = frozenset("html body table ul ol dl td th article section div main aside nav header footer form blockquote".split())
#: Words in class names, ids and roles of what is no article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|banner|footer|colophon|contentinfo|sidebar|"
    r"complementary|aside|rail|widgets?|ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed)?|promos?|promotion|"
    r"comments?|commentlist|disqus|respond|replies|notices?|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|search|share|sharing|social|related|recommended|recommendations|pagination|pager|toolbar|"
    r"disclaimer|skip-?link|alert|toast)(?=$|[\s_-])",
    re.I,
)
_OTHER_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|replies|related|recommended|promos?|sponsor(?:ed)?|ads?|adverts?)(?=$|[\s_-])", re.I)
#: Elements that hold one block of text; a class name tells something of them only as a whole.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 pre figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MODIFIER = re.compile(r"\b(?:has|with|no|without|is|not)[-_][\w-]*", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


class _Element:
    __slots__ = ("tag", "path", "skipped", "titles", "linked", "number")

    def __init__(self, tag, path, skipped, titles, linked, number):
        #: titles: skipped but for headings, as the header of an article is
        self.tag, self.path, self.skipped, self.titles, self.linked, self.number = tag, path, skipped, titles, linked, number


def _noise(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display:\s*none", attributes.get("style", "")):
        return True
    names = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
    if tag in TEXTS:
        return any(NOISE.fullmatch(name) for name in names.split())
    words = _OTHER_ARTICLE if tag == "article" else NOISE
    return bool(names.strip()) and bool(words.search(_MODIFIER.sub(" ", names)))


def _step(tag: str, attributes: dict[str, str]) -> str:
    """A tag with its classes, digits generalised, so that pages of one template agree."""
    classes = sorted({re.sub(r"\d+", "0", c) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *classes])


def blocks_of(page: str) -> list[tuple[str, int, list[tuple[str, int]]]]:
    """Blocks of text in page order: (text, characters inside links, containers as (path, number) outside in).

    Skipped elements are left out. Broken markup is read as far as it goes; a tag cut
    off at the end of the page is no text.
    """
    out: list[tuple[str, int, list[tuple[str, int]]]] = []
    stack: list[_Element] = [_Element("", "", False, False, False, 0)]
    text: list[str] = []
    linked = number = at = 0

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            out.append((joined, linked, [(e.path, e.number) for e in stack if e.tag in CONTAINERS or not e.tag]))
        text.clear()
        linked = 0

    def close(down_to: int) -> None:
        if any(e.tag in BLOCKS for e in stack[down_to:]):
            flush()
        del stack[down_to:]

    def said(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].skipped:
            raw = html.unescape(raw)
            text.append(raw)
            if stack[-1].linked:
                linked += len(raw.strip())

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            said(page[at:] if "<" not in page[at:] or not re.search(r"</?[a-zA-Z!][^>]*\Z", page[at:]) else page[at : page.rindex("<")])
            break
        said(page[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k:
                close(k)
            elif tag == "p":
                flush()
            continue
        attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(m[3])}
        ends = CLOSES.get(tag)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                elif stack[i].tag in SCOPES:
                    break
        if tag in BLOCKS:
            flush()
        elif tag == "br" and not stack[-1].skipped:
            text.append(" ")
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS and tag != "a":
            continue
        top = stack[-1]
        number += 1
        noise = _noise(tag, attributes)
        skipped = top.skipped or tag in SKIPPED or noise
        titles = not noise and (
            top.titles and tag not in SKIPPED or tag == "header" and not top.skipped and any(e.tag == "article" for e in stack)
        )
        if titles and tag in HEADINGS:
            skipped = titles = False
        path = f"{top.path}/{_step(tag, attributes)}" if tag in CONTAINERS else top.path
        stack.append(_Element(tag, path, skipped, titles, top.linked or tag == "a", number))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end is None:
                break
    flush()
    return out


def scores(blocks: list[tuple[str, int, list[tuple[str, int]]]]) -> dict[tuple[str, int], float]:
    """Score of each container: its own text counts in full, that of containers inside it by halves per level.

    Text inside links counts against it; article and main elements count double.
    """
    out: dict[tuple[str, int], float] = {}
    for text, linked, inside in blocks:
        worth = len(text) - 2 * min(linked, len(text))
        for level, key in enumerate(reversed(inside)):
            name = key[0].rsplit("/", 1)[-1].split(".")[0]
            out[key] = out.get(key, 0.0) + worth * 0.5**level * (2 if name in ("article", "main") else 1)
    return out


def widen(blocks: list[tuple[str, int, list[tuple[str, int]]]], best: tuple[str, int]) -> tuple[str, int]:
    """The container that holds the whole article of which `best` holds a part.

    An article around it is taken as a whole. Otherwise the outermost container below the
    body whose blocks outside of `best` have less unlinked text than `best` itself, and
    whose every step outwards adds no more text in links than out of them.
    """
    above = next(inside for _, _, inside in blocks if best in inside)
    names = [path.rsplit("/", 1)[-1].split(".")[0] for path, _ in above]
    at = above.index(best)
    article = next((k for k in range(at, -1, -1) if names[k] == "article"), None)
    if article is not None:
        return above[article]
    plain, links = [0] * (at + 1), [0] * (at + 1)
    for text, linked, inside in blocks:
        for k in range(min(at + 1, len(inside))):
            if inside[k] != above[k]:
                break
            plain[k] += len(text) - min(linked, len(text))
            links[k] += linked
    wide = at
    for k in range(at - 1, -1, -1):
        if names[k] in ("", "html", "body") or plain[k] - plain[at] >= plain[at] or links[k] - links[wide] > plain[k] - plain[wide]:
            break
        wide = k
    return above[wide]


def best_container(blocks: list[tuple[str, int, list[tuple[str, int]]]], scored: dict[tuple[str, int], float]) -> tuple[str, int] | None:
    """The container with the best score, of equals the first, widened to its article; none without text."""
    return widen(blocks, max(scored, key=scored.get)) if scored else None


def best_path(page: str) -> str | None:
    """The generalised path of the best container."""
    blocks = blocks_of(page)
    best = best_container(blocks, scores(blocks))
    return best and best[0]


def extract(page: str, winners: list[str]) -> str:
    """The text in the containers of the first path that the page has, else in its own best container.

    Of several containers with that path, those that mostly hold links are left out.
    """
    blocks = blocks_of(page)
    scored = scores(blocks)
    good = {path for (path, _), score in scored.items() if score > 0}
    path = next((w for w in winners if w in good), None)
    if path is None:
        path = (best_container(blocks, scored) or ("", 0))[0]
    chosen = {key for key, score in scored.items() if key[0] == path and (score > 0 or path not in good)}
    return "\n\n".join(text for text, _, inside in blocks if not chosen.isdisjoint(inside))


def host_of(url: str = "url"):
    """Host of an address in lower case, without user and port; a missing or odd one is an empty name."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def vote(pages: DataFrame) -> DataFrame:
    """(host, winners): the paths of each host that won, most votes first, of equals in the order of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [best_path(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    read = pages.select(host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    votes = cut_lineage(
        read.mapInArrow(run, "host string, path string").where("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    )
    total = votes.groupBy("host").agg(F.sum("n").alias("total"))
    won = votes.join(total, "host").where(F.col("n") >= SHARE * F.col("total"))
    ranked = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("ranked"))
    return ranked.select("host", F.col("ranked.path").alias("winners"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html).

    A missing page is an empty one; without text, text is empty. Ids may be missing or
    repeat. A missing address belongs to the host with the empty name. Other columns
    don't matter; no rows give no rows. Blocks are joined by an empty line.
    """
    winners = cut_lineage(vote(pages))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    if winners.limit(SMALL + 1).count() <= SMALL:
        placed = rows.join(F.broadcast(winners), "host", "left")
    else:  # Spark splits the partitions of large hosts
        placed = rows.join(winners, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, w or []) for p, w in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return placed.select("page_id", "url", "html", "winners").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
