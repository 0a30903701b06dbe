"""Main text of web pages: the contiguous run of words and tags with the largest sum of scores.

A page is read once as a list of tokens, runs of words and tags.  Words score positive and
tags negative; how much is learned from pages whose markup says where the article is, as
log-odds of standing inside it.  Words of containers that stand outside articles (menus,
page footers, adverts) score negative.  One linear scan finds the best region; blocks of
such containers inside it are left out of the text.
"""

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: About so many distinct pages with a marked article are learned from, whatever the
#: number of pages; what fewer than MIN_PAGES of them show is not learned.
SAMPLE_PAGES = 1000
MIN_PAGES = 3
_STEPS = 1 << 30
_MOST = 6.0  # largest weight of one token, either way
_WORD, _TAG, _OUTSIDE = 1.0, -1.0, -2.0  # where nothing was learned
_LEAST_COST = 0.05  # of any tag
_RUN = 5  # a run beside the article costs as so many words at most, so that an advert does not part it

_TOKEN = re.compile(
    r"<!--[\s\S]*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=(?:\s*+(?:\"[^\"]*\"|'[^']*'))?+)*+)(?:>|\Z)"
)
_HINT = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option"
    " p pre search section select summary svg table tbody template tfoot thead tr ul".split()
)
_SPACES = frozenset({"br", "td", "th", "img", "input"})
#: Text up to their end tag is no markup and no part of a page's text.
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _RAW}
#: Containers that are no part of an article.
_BESIDE = frozenset("aside button dialog footer form menu nav noscript select svg template".split())
_BESIDE_PARTS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs consent cookie cookies disclaimer"
    " footer login menu modal nav navbar navigation newsletter notice notices outbrain pagination popup promo promotion"
    " promoted related search share sharing sidebar signup social sponsor sponsored subscribe taboola toolbar widget"
    .split()
)
_COMMENT_PARTS = frozenset("comment comments commentlist disqus respond replies".split())
_BESIDE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
_CLOSED_BY = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "option": {"option"},
    "tbody": {"tr", "tbody", "thead"}, "tfoot": {"tr", "tbody", "thead"},
}
_INSIDE, _BY, _COMMENTS = 0, 1, 2


def _kind(name: str, attributes: str, marked: bool) -> tuple[int, str]:
    """(whether a container stands beside the article, its first class)."""
    beside = name in _BESIDE or name == "header" and not marked
    kind, label = (_BY if beside else _INSIDE), ""
    if not attributes:
        return kind, label
    for match in _HINT.finditer(attributes):
        what, value = match[1].lower(), (match[2] or match[3] or match[4] or "").strip().lower()
        if what == "hidden" and value != "until-found" or what == "aria-hidden" and value == "true":
            kind = kind or _BY
        elif what == "role":
            kind = kind or (_BY if value in _BESIDE_ROLES else _INSIDE)
        elif what in ("class", "id") and value:
            label = label or re.sub(r"\d+", "0", value.split()[0])
            if name in ("body", "html"):
                continue
            parts = set(_PARTS.split(value))
            if parts & _COMMENT_PARTS:
                kind = _COMMENTS
            elif parts & _BESIDE_PARTS or "header" in parts and not marked:
                kind = kind or _BY
    return kind, label


class Token:
    """A run of text or a tag, with what its score is looked up by."""

    __slots__ = ("text", "name", "keys", "words", "outside", "marked", "within", "begin", "end")

    def __init__(self, text, name, keys, words, outside, place, begin, end):
        self.text, self.name, self.keys, self.words = text, name, keys, words
        self.outside, self.begin, self.end = outside, begin, end
        self.marked, self.within = place


def tokens(page: str) -> list[Token]:
    """The tokens of a page, in order.  Any text is a page; it is read once from left to right.

    ``outside`` is set within containers that stand beside the article; a new article or
    main element ends one that was left open, unless it holds reader comments.  ``within``
    is set in an article or main element, ``marked`` there but for such containers in it.
    """
    out: list[Token] = []
    stack: list[tuple] = []  # (name, label, kind outside, (marked, within)) of open blocks
    opened: Counter = Counter()
    texts: list[str] = []
    state = {"begin": 0, "end": 0}

    def beside() -> int:
        return stack[-1][2] if stack else _INSIDE

    def place() -> tuple[bool, bool]:
        return stack[-1][3] if stack else (False, False)

    def flush():
        if not texts:
            return
        text = html.unescape("".join(texts))
        texts.clear()
        words = len(text.split())
        outside = beside()
        if outside:
            keys = ("w outside",)
        else:
            parent = stack[-1][1] if stack else ""
            holder = stack[-2][1] if len(stack) > 1 else ""
            keys = (f"w {parent} in {holder}", f"w {parent}", "w")
        out.append(Token(text, None, keys, words, bool(outside), place(), state["begin"], state["end"]))

    def tag_keys(outside: bool, *labels) -> tuple:
        return ("t outside",) if outside else (*(f"t {label}" for label in labels), "t")

    def close(names):
        while stack and stack[-1][0] in names:
            opened[stack.pop()[0]] -= 1

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        match = _TOKEN.match(page, start) if start < size else None
        stop = start if match or start == size else start + 1
        if stop > at:
            if not texts:
                state["begin"] = at
            texts.append(page[at:stop])
            state["end"] = stop
        at = stop
        if not match:
            continue
        at = match.end()
        name = match[2]
        if name is None:  # a comment or declaration
            continue
        name, closing = name.lower(), bool(match[1])
        flush()
        if closing:
            outside = bool(beside())
            out.append(Token(None, name, tag_keys(outside, f"/{name}"), 0, outside, place(), start, at))
            if name in _BLOCKS and opened[name]:
                while stack[-1][0] != name:
                    opened[stack.pop()[0]] -= 1
                opened[stack.pop()[0]] -= 1
            continue
        if name in _RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else size
            out.append(Token(None, name, tag_keys(bool(beside()), name), 0, True, place(), start, at))
            continue
        label = name
        if name in _BLOCKS:
            close({"p"})
            close(_CLOSED_BY.get(name, ()))
            kind, first = _kind(name, match[3], place()[0])
            label = f"{name}.{first}" if first else name
            article = name in ("article", "main")
            around = beside()
            if article and around != _COMMENTS:
                around = _INSIDE
            inside = kind == _INSIDE and around == _INSIDE and (article or place()[0])
            within = article and not kind and not around or place()[1]
            if name != "hr":
                stack.append((name, label, max(kind, around), (inside, within)))
                opened[name] += 1
        keys = tag_keys(bool(beside()), label, name)
        out.append(Token(None, name, keys, 0, bool(beside()), place(), start, at))
    flush()
    return out


def counted(page: str) -> dict[str, list[int]]:
    """How often each key of a page stands inside its marked article and elsewhere."""
    found: dict[str, list[int]] = {}
    for token in tokens(page):
        n = token.words if token.name is None else 1
        if n:
            for key in token.keys:
                found.setdefault(key, [0, 0])[not token.marked] += n
    return found


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of standing inside the article, by key; tags always cost something."""
    made = {}
    for key, (inside, elsewhere) in counts.items():
        odds = max(-_MOST, min(_MOST, math.log((inside + 0.5) / (elsewhere + 0.5))))
        if key in ("w outside", "t outside"):
            odds = min(odds, _OUTSIDE)
        elif key == "t":
            odds = min(odds, _TAG)
        elif key == "w":
            odds = max(odds, _WORD)
        elif key.startswith("t "):
            odds = min(odds, -_LEAST_COST)
        made[key] = odds
    return made


_DEFAULTS = {"w": _WORD, "t": _TAG, "w outside": _OUTSIDE, "t outside": _OUTSIDE}


def score(token: Token, weights: dict[str, float]) -> float:
    """What a token adds to its region.  Where a page marks its article, its words gain and
    all else there costs least; elsewhere the weight of its nearest key known counts."""
    if token.within and not (token.marked and token.words):
        return -_LEAST_COST
    key = next((k for k in token.keys if k in weights), None)
    weight = _DEFAULTS[token.keys[-1]] if key is None else weights[key]
    if token.name is not None:
        return weight
    if token.outside:
        return weight * min(token.words, _RUN)
    return token.words * (max(weight, _WORD) if token.marked else weight)


def best_region(scores: list[float]) -> tuple[int, int, float]:
    """(first, past the last, sum) of the slice with the largest sum, by one scan.

    Of equal sums the slice that ends first, and of those with one end the shortest.
    Without a positive score it is empty.
    """
    best, first, last = 0.0, 0, 0
    total, begin = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, first, last = total, begin, i + 1
    return first, last, best


def extract(page: str | None, weights: dict[str, float]) -> tuple[str, int, int, float]:
    """(text, begin, end, score) of the main text; begin and end are places in the page."""
    found = tokens(page) if page else []
    first, last, best = best_region([score(t, weights) for t in found])
    region = found[first:last]
    blocks: list[str] = []
    pieces: list[str] = []

    def end_block():
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            blocks.append(text)

    for token in region:
        if token.name is None:
            if not token.outside:
                pieces.append(token.text)
        elif token.name in _BLOCKS:
            end_block()
        elif token.name in _SPACES:
            pieces.append(" ")
    end_block()
    return "\n".join(blocks), region[0].begin if region else 0, region[-1].end if region else 0, best


def fit_weights(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights learned from pages that mark their article with an article or main element.

    About ``sample_pages`` distinct pages, chosen by their hash and so alike at every size
    of the table and however often one page is repeated; read whole.  The driver gets a
    pair of counts per tag or container that MIN_PAGES of them show.  Without such pages
    every word scores 1 and every tag -1.
    """
    page = F.col(html_col).cast("string")
    marked = pages.select(page.alias("page")).where(F.col("page").rlike(r"(?i)<(article|main)[\s>]"))
    h = F.xxhash64("page")
    distinct = marked.agg(F.approx_count_distinct(h).alias("d")).first()["d"]
    share = math.ceil(_STEPS * sample_pages / max(distinct, 1))
    slot = F.pmod(h, F.lit(_STEPS))
    sample = marked.where(slot < min(share, _STEPS)).groupBy(h.alias("h")).agg(F.max("page").alias("page"))

    def count(batches):
        for batch in batches:
            keys, inside, elsewhere = [], [], []
            for text in batch.column(0).to_pylist():
                for key, (a, b) in counted(text).items():
                    keys.append(key)
                    inside.append(a)
                    elsewhere.append(b)
            columns = [pa.array(keys, pa.string()), pa.array(inside, pa.int64()), pa.array(elsewhere, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "inside", "elsewhere"])

    counts = (
        sample.select("page")
        .mapInArrow(count, "key string, inside bigint, elsewhere bigint")
        .groupBy("key")
        .agg(F.sum("inside").alias("inside"), F.sum("elsewhere").alias("elsewhere"), F.count("*").alias("n"))
        .where(F.col("n") >= min(MIN_PAGES, max(distinct, 1)))
    )
    return weights_of({r["key"]: (r["inside"], r["elsewhere"]) for r in counts.collect()})


def main_text(
    pages: DataFrame,
    weights: dict[str, float],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(id, url, text, n_chars, begin, end, score) of every row, from its whole page.

    The text is that of the region's blocks, in order and joined by line feeds:
    character references decoded, white space made one space, trimmed.  Containers that
    are no part of an article (menus, page headers, footers, sidebars, notices, adverts,
    forms, scripts, reader comments) are left out of it.  ``begin`` and ``end`` say
    where the region stands in the page.  A null page counts as empty; without a word that
    scores above 0 the text is empty.  Of regions with equal scores the first counts.
    Repeated rows give repeated rows, an empty table none.
    """
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("_page"))
    schema = T.StructType(
        [*rows.schema.fields[:2], T.StructField("text", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("n_chars", "begin", "end")]
        + [T.StructField("score", T.DoubleType())]
    )

    def each(batches):
        for batch in batches:
            start = size = 0
            found: list[tuple] = []
            for i, page in enumerate(batch.column(2)):
                text, begin, end, best = extract(page.as_py(), weights)
                found.append((text, len(text), begin, end, best))
                size += len(text)
                if size > 1 << 23:
                    yield made(batch, start, found)
                    start, size, found = i + 1, 0, []
            yield made(batch, start, found)

    def made(batch, start, found):
        columns = list(zip(*found)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        own = [batch.column(i).slice(start, len(found)) for i in range(2)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.names)

    return rows.mapInArrow(each, schema)
