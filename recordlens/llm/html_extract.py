"""Main text of web pages by consensus over the pages of a host.

Each page scores its containers: text outside links and page furniture, less a share of the
links and furniture inside. A container is named by its path of tags and classes with
numbers generalised away. Spark sums the scores of equal paths per host, the best path of
each host wins, and every page is extracted again below the elements on the winning path.
A page that has no text there, or whose host is unknown, uses its own best path.

Blocks are paragraphs, headings, list items, cells and other block elements, in page order;
``br`` is white space. Defined results: null or empty html gives an empty text; pages
without a container give their whole body less furniture; rows repeating an id stay rows of
their own; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.store import stored
from recordlens.llm.token_ids import utf8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Element names of HTML, and words that name page furniture.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe svg math select object xmp".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre td th tr tbody thead tfoot caption figcaption hr".split())
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPES = set("ul ol dl table div article section main aside nav header footer body td th blockquote".split())
_FURNITURE_TAGS = set("nav footer aside form button dialog menu head".split())
_FURNITURE_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside rail footer "
    "foot masthead topbar banner ad ads adv advert adverts advertisement advertising sponsor "
    "sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist disqus respond "
    "replies share sharing social related recommended recommendations pagination pager widget "
    "search copyright disclaimer hidden form toolbar skip".split()
)
_FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
_HEADER_WORDS = {"header", "heading", "head"}
_MAIN_WORDS = set("article main content post entry story body text articlebody".split())
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())


def _own_words(names: str) -> set[str]:
    """Words of class and id names, without names that say what an element has or lacks."""
    found = [_words(name) for name in names.split()]
    return {w for words in found if not {"has", "with", "no", "without"} & set(words) for w in words}


class _Element:
    __slots__ = ("tag", "path", "furniture", "inside_main", "link")

    def __init__(self, tag: str, attributes: str, parent: _Element | None):
        found = {}
        if attributes and not attributes.isspace():
            for k, *v in _ATTRIBUTE.findall(attributes):
                found.setdefault(k.lower(), html.unescape("".join(v)))
        classes = found.get("class", "")
        words = _own_words(f"{classes} {found.get('id', '')}") if found else set()
        role = found.get("role", "").lower()
        main = tag in ("article", "main") or role in ("main", "article")
        above = parent is not None and parent.inside_main
        self.tag = tag
        self.link = tag == "a" or (parent is not None and parent.link)
        header = (tag == "header" or words & _HEADER_WORDS) and not above and not main
        self.furniture = (parent is not None and parent.furniture) or (
            tag not in ("html", "body")
            and (
                tag in _FURNITURE_TAGS
                or bool(header and tag not in _LEAVES)
                or (not main and bool(words & _FURNITURE_WORDS))
                or role in _FURNITURE_ROLES
                or found.get("aria-hidden", "").lower() == "true"
                or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
                or "hidden" in found
                or bool(re.search(r"(?:^|\s)hidden(?:\s|$)", _ATTRIBUTE.sub("", attributes)))
            )
        )
        self.inside_main = above or main
        name = tag + "".join(f".{re.sub(r'[0-9]+', 'N', c)}" for c in sorted(set(classes.split())))
        up = parent.path if parent else ""
        self.path = up if tag in _INLINE or tag in _LEAVES else f"{up}>{name}"


def _blocks(source: str) -> Iterator[tuple[str, str, int, bool]]:
    """Blocks in page order: path of the container, text, characters in links, furniture."""
    root = _Element("html", "", None)
    stack = [root]
    pieces: list[str] = []
    linked, at, n = 0, 0, len(source)

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            found, linked = min(linked, len(text)), 0
            if text:
                return [(stack[-1].path, text, found, stack[-1].furniture)]
        linked = 0
        return ()

    def keep(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    while at < n:
        token = _TOKEN.search(source, at)
        if not token:
            keep(source[at:])
            break
        keep(source[at : token.start()])
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        closing, attributes = token[1] or token[4], token[3] or token[6] or ""
        block = tag not in _INLINE
        if block:
            yield from flush()
        elif tag == "br":
            pieces.append(" ")
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if stack[k].furniture != stack[k - 1].furniture:
                        yield from flush()
                    del stack[k:]
                    break
                if not block and stack[k].tag not in _INLINE:
                    break
            continue
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*(?:>|\\Z)", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag in _VOID or tag == "html":
            continue
        if block:
            closes = _CLOSED_BY.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPES:
                    break
        element = _Element(tag, attributes, stack[-1])
        if element.furniture != stack[-1].furniture:
            yield from flush()
        stack.append(element)
    yield from flush()


def container_scores(source: str) -> dict[str, float]:
    """The score of every container path of a page."""
    good: dict[str, float] = {}
    bad: dict[str, float] = {}
    for path, text, linked, furniture in _blocks(source):
        parts = path.split(">")
        for k in range(2, len(parts) + 1):
            name = ">".join(parts[:k])
            if furniture:
                bad[name] = bad.get(name, 0) + len(text)
            else:
                good[name] = good.get(name, 0) + len(text) - linked
                bad[name] = bad.get(name, 0) + linked
    scores = {}
    for path, chars in good.items():
        value = chars - 0.5 * bad.get(path, 0)
        if value > 0:
            last = set(_words(path.rsplit(">", 1)[-1]))
            depth = path.count(">")
            scores[path] = value * (1 + depth / 100) * (1.5 if last & (_MAIN_WORDS - {"body"}) else 1.0)
    return scores


def _best(scores: dict[str, float]) -> str | None:
    return max(scores, key=lambda p: (scores[p], p)) if scores else None


def main_text(source: str, path: str | None) -> str:
    """The text below ``path``, or below the page's own best path where that has none."""
    blocks = [b for b in _blocks(source) if not b[3]]

    def below(top: str) -> list[str]:
        return [text for own, text, _, _ in blocks if own == top or own.startswith(top + ">")]

    found = below(path) if path else []
    if not found:
        own = _best(container_scores(source))
        found = below(own) if own else [b[1] for b in blocks]
    return "\n".join(found)


def extract(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """One row per page: id, url, ``text``, ``n_chars`` and the ``path`` its host voted for."""
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url).alias("url"),
        F.lower(F.regexp_extract(F.col(url), _HOST, 1)).alias("host"), F.col(source).alias("html"),
    )

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, content in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                scores = container_scores(content.decode())
                total = max(scores.values(), default=0.0)
                for path, score in scores.items():
                    sums[host, path] = sums.get((host, path), 0.0) + score / total
            if sums:
                hosts, paths = zip(*sums)
                yield pa.RecordBatch.from_pydict(
                    {"host": list(hosts), "path": list(paths), "score": list(sums.values())}
                )

    votes = rows.where("host <> ''").select("host", "html").mapInArrow(vote, "host string, path string, score double")
    winners = (
        votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
        .groupBy(F.col("host").alias("voting")).agg(F.max_by("path", F.struct(F.round("score", 6), "path")).alias("path"))
    )
    # Written, so that both sides of the join are plain shuffles and Spark can split a host
    # that has a large share of the pages.
    winners = stored(winners, "winning-paths")
    joined = rows.join(winners.hint("shuffle_hash"), F.col("host") == F.col("voting"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(content.decode(), path)
                for content, path in zip(utf8(batch.column(2)), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), batch.column(3)],
                [id_col, url, "text", "n_chars", "path"],
            )

    kind = f"`{id_col}` {dict(rows.dtypes)['id']}, `{url}` string, text string, n_chars long, path string"
    return joined.select("id", "url", "html", "path").mapInArrow(run, kind)
