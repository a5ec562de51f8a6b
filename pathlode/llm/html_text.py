"""Main text of web pages: marked structure, and the runs that pages of a host share.

A page is cut into blocks. Blocks within menus, headers, footers, sidebars, notices, adverts,
forms and comments go. All else is decided by the host's suffix array: the token streams of its
pages, outside the article, are laid end to end, and suffixes are sorted by their first ``RUN``
tokens (longer ones need not be told apart). Whole blocks, from border to border, are runs too: all
blocks of the article, and those outside it that are shorter than ``RUN``. The sort is a shuffle
by host and suffix, so no host is ever one task, and every run counts however far apart its pages lie.

A run is repeated if enough distinct contents of the host have it: copies of a page under other
ids or urls count once, and a passage quoted on a second page is no boilerplate. Open blocks that
repeated runs cover go. Within the article the markup speaks for the text, so a block goes only if
it is repeated as a whole on at least half of the host's contents; an article of which nothing else
would be left is a copy and stays.
"""

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathlode.llm.common import key_kind, stored

# Tokens that make a run worth the name, and the share of a block that runs must cover.
RUN, COVERED = 8, 0.5
# Distinct contents that a repeated run is on: so many at least, and these shares of the host's. A host
# with fewer contents needs the run on all of them (two at least), but within an article never fewer.
PAGES, OPEN_SHARE, MAIN_SHARE = 3, 0.1, 0.5
# Parts into which the runs of one host are dealt.
_PARTS = 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
# Where no tag ends any more, this ends the text; a lone ``<`` before it is text.
_OPEN_END = re.compile(r"<[!?/]")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NAME = re.compile(r"[a-z]+")

# Elements of HTML by what they do to text.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea xmp iframe noembed noframes noscript template".split())
_BREAKING = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
_NO_PARAGRAPH = _BREAKING - {"br", "option", "optgroup", "html", "body"}
_SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_LISTS = set("ul ol dl table select menu".split())

_CHROME_ELEMENTS = set(
    "nav aside footer form button select dialog menu search svg object canvas audio video".split()
)
_CHROME_ROLES = set(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
    "toolbar".split()
)
_CHROME_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent "
    "notice banner popup modal overlay newsletter subscribe signup login comment comments disqus "
    "reply replies respond share sharing social related recommended recommendations widget toolbar "
    "pagination pager paywall skip".split()
)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BODY_NAMES = ({"article", "body"}, {"article", "content"}, {"post", "content"}, {"entry", "content"})

_ARTICLE, _MAIN, _OPEN, _CHROME = "article", "main", "open", "chrome"


def _attributes(text: str) -> dict[str, str]:
    return {
        m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)
    }


def _region(tag: str, attributes: str, within: str) -> str:
    """The region that an element opens within another one."""
    if within == _CHROME or tag in _CHROME_ELEMENTS:
        return _CHROME
    if tag in ("html", "body"):
        return within
    if tag == "header" and within not in (_ARTICLE, _MAIN):
        return _CHROME
    at = _attributes(attributes) if "=" in attributes or "hidden" in attributes else {}
    named = f"{at.get('class', '')} {at.get('id', '')}".lower()
    names = {*_NAME.findall(named), *("".join(_NAME.findall(n)) for n in named.split())}
    role = at.get("role", "").lower()
    if tag == "article" or at.get("itemprop") == "articleBody" or role == "article":
        # Readers' comments are often marked as articles too.
        return _CHROME if names & _CHROME_NAMES else _ARTICLE
    if (
        role in _CHROME_ROLES
        or names & _CHROME_NAMES
        or "hidden" in at
        or at.get("aria-hidden", "").lower() == "true"
        or _HIDDEN.search(at.get("style", ""))
    ):
        return _CHROME
    if any(body <= names for body in _BODY_NAMES):
        return _ARTICLE
    if within == _OPEN and (tag == "main" or role == "main" or names & {"content", "main"}):
        return _MAIN
    return within


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(region, text) of a page's blocks in page order; text is decoded, trimmed, single-spaced."""
    found: list[tuple[str, str]] = []
    parts: list[str] = []
    # Open elements: tag, region, and the place of the innermost block among them.
    stack: list[tuple[str, str, int]] = []
    opened_tags: Counter[str] = Counter()
    region, at = _OPEN, 0
    page = page or ""
    last_end = page.rfind(">")

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((region, text))
            parts.clear()

    def leave(k: int) -> None:
        """Close the elements from place ``k`` on."""
        opened_tags.subtract(t for t, _, _ in stack[k:])
        del stack[k:]

    while True:
        if at > last_end:
            end = _OPEN_END.search(page, at)
            parts.append(page[at : end.start()] if end else page[at:])
            break
        mark = _TOKEN.search(page, at)
        if mark is None:
            parts.append(page[at:])
            break
        if mark.start() > at:
            parts.append(page[at : mark.start()])
        at = mark.end()
        name = mark[2] or mark[5]
        if not name:
            continue
        tag, closing = name.lower(), mark[1] or mark[4]
        if tag in _BREAKING:
            flush()
        if closing:
            if opened_tags[tag]:
                k = len(stack) - 1
                if tag not in _BREAKING:
                    # A stray inline end tag never closes a block.
                    while stack[k][0] not in _BREAKING and stack[k][0] != tag:
                        k -= 1
                    if stack[k][0] != tag:
                        leave(k + 1)
                        continue
                while stack[k][0] != tag:
                    k -= 1
                leave(k)
        elif tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        elif tag not in _VOID:
            if tag in _NO_PARAGRAPH:
                block = stack[-1][2] if stack else -1
                if block >= 0 and stack[block][0] == "p":
                    leave(block)
            if any(opened_tags[t] for t in _SIBLINGS.get(tag, ())):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _SIBLINGS[tag]:
                        leave(k)
                        break
                    if stack[k][0] in _LISTS:
                        break
            within = stack[-1][1] if stack else _OPEN
            opened = _region(tag, mark[3] or mark[6] or "", within)
            if opened != within:
                flush_before(parts, found, region)
            if not (mark[3] or mark[6] or "").endswith("/") or tag in _BREAKING:
                block = len(stack) if tag in _BREAKING else stack[-1][2] if stack else -1
                stack.append((tag, opened, block))
                opened_tags[tag] += 1
        now = stack[-1][1] if stack else _OPEN
        if now != region:
            flush()
            region = now
    flush()
    return found


def flush_before(parts: list[str], found: list[tuple[str, str]], region: str) -> None:
    """End a block where an inline element opens another region."""
    text = " ".join(html.unescape("".join(parts)).split())
    if text:
        found.append((region, text))
    parts.clear()


def settled(page: list[tuple[str, str]]) -> str | None:
    """The region that holds the main text by the markup, if it says so."""
    regions = {r for r, _ in page}
    return next((r for r in (_ARTICLE, _MAIN) if r in regions), None)


def suffixes(page: list[tuple[str, str]], seed: int = 0) -> list[tuple[int, int]]:
    """(position, hash) of a page's runs; the hash's lowest bit tells those of the article.

    Runs of the outside token stream are the first ``RUN`` tokens of each suffix, at their
    position; shorter suffixes are no runs, but a stream that is shorter itself is one. Block k
    as a whole is at ``-1 - k``.
    """
    main, tokens, found = settled(page), [], []

    def digest(kind: str, text: str, bit: int) -> int:
        value = xxhash.xxh64_intdigest(kind + text, seed) & ~1 | bit
        return value - (1 << 63)

    for k, (region, text) in enumerate(page):
        words = text.split()
        if region == main:
            found.append((-1 - k, digest("block ", text, 1)))
            continue
        tokens += words
        if len(words) < RUN:
            found.append((-1 - k, digest("block ", text, 0)))
    starts = range(max(len(tokens) - RUN + 1, min(len(tokens), 1)))
    found += [(k, digest("", " ".join(tokens[k : k + RUN]), 0)) for k in starts]
    return found


def kept(page: list[tuple[str, str]], repeated: set[int]) -> tuple[str, int]:
    """The main text, and how many outside tokens lie in runs.

    ``repeated`` has the positions of the repeated runs, as ``suffixes`` gives them.
    """
    return _kept([(r, t, len(t.split())) for r, t in page], repeated)


def _kept(page: list[tuple[str, str | None, int]], repeated: set[int]) -> tuple[str, int]:
    """As ``kept``, from blocks with their sizes; only blocks that may stay need a text."""
    main = settled([(r, t) for r, t, _ in page])
    at, covered, texts = 0, 0, []
    in_run = np.zeros(sum(n for r, _, n in page if r != main) + RUN, dtype=bool)
    for k in repeated:
        if k >= 0:
            in_run[k : k + RUN] = True
    for k, (region, text, size) in enumerate(page):
        if region == main:
            if -1 - k not in repeated:
                texts.append(text)
            continue
        runs = size if -1 - k in repeated else int(in_run[at : at + size].sum())
        at, covered = at + size, covered + runs
        if main is None and region == _OPEN and runs < COVERED * size:
            texts.append(text)
    if main and not texts:
        texts = [t for r, t, _ in page if r == main]
    return " ".join(texts), covered


def _suffix_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for host, page in zip(batch["host"], batch["html"], strict=True):
            seed, page = xxhash.xxh64_intdigest(host), blocks(page)
            content = xxhash.xxh64_intdigest("\n".join(t for _, t in page), seed)
            runs = [{"at": k, "run": run} for k, run in suffixes(page, seed)]
            found.append((seed - (1 << 63), content - (1 << 63), runs))
        yield pd.DataFrame(
            {
                "mark": batch["mark"],
                "site": [f[0] for f in found],
                "content": [f[1] for f in found],
                "runs": [f[2] for f in found],
            }
        )


def _block_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of each page, with the texts of those that may stay, as a zstandard frame of JSON."""
    pack = zstandard.ZstdCompressor().compress
    for batch in batches:
        rows = []
        for page in batch["html"]:
            page = blocks(page)
            may = settled(page) or _OPEN
            parts = [(r, t if r == may else None, len(t.split())) for r, t in page]
            rows.append(pack(json.dumps(parts, ensure_ascii=False).encode()))
        yield pd.DataFrame(
            {"mark": batch["mark"], "page_id": batch["page_id"], "url": batch["url"], "blocks": rows}
        )


@F.pandas_udf(StructType().add("text", "string").add("n", "long"))
def _decided(pages: pd.Series, repeated: pd.Series) -> pd.DataFrame:
    unpack = zstandard.ZstdDecompressor().decompress

    def one(page, runs):
        return _kept(json.loads(unpack(page)), set() if runs is None else {int(k) for k in runs})

    rows = [one(*row) for row in zip(pages, repeated, strict=True)]
    return pd.DataFrame(rows, columns=["text", "n"])


def _repeated(rows: DataFrame) -> DataFrame:
    """The ``run``s that enough distinct contents of their site have."""
    totals = rows.select("site", "content").distinct().groupBy("site").agg(F.count("*").alias("total"))
    parts = F.explode(F.array(*[F.lit(k) for k in range(_PARTS)])).alias("part")
    runs = (
        rows.select("run", "content", "site")
        .distinct()
        .groupBy("run")
        .agg(F.count("*").alias("n"), F.min("site").alias("site"))
        .filter("n > 1")
        # The lowest bit is the kind, so the part comes from the bits above it.
        .withColumn("part", F.shiftrightunsigned("run", 1).bitwiseAND(_PARTS - 1).cast("int"))
        .join(totals.select("site", "total", parts), ["site", "part"])
    )
    open_least = F.greatest(F.least(F.lit(PAGES), "total"), F.col("total") * OPEN_SHARE)
    main_least = F.greatest(F.lit(PAGES), F.col("total") * MAIN_SHARE)
    in_main = F.col("run").bitwiseAND(1) == 1
    return runs.filter(F.col("n") >= F.when(in_main, main_least).otherwise(open_least)).select("run")


def main_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``, ``n_repeated``.

    ``n_repeated`` counts the words outside the main text that runs cover. Null and empty
    pages, and pages without text, have an empty text. Null urls are one host. Pages whose
    blocks have the same texts are one content to the suffix array, and each has its row.
    """
    kind = pages.schema[key].dataType
    pages = pages.select(
        F.col(key).cast(key_kind(kind)).alias("page_id"),
        F.col(url).alias("url"),
        F.col(page).alias("html"),
    ).withColumn("mark", F.xxhash64("page_id", "url", "html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[^:/?#]+:)?//([^/?#]*)", 1))
    rows = stored(
        pages.select("mark", host.alias("host"), "html")
        .mapInPandas(
            _suffix_rows, "mark long, site long, content long, runs array<struct<at: int, run: long>>"
        )
        .select("mark", "site", "content", F.inline("runs")),
        "suffixes",
    )
    found = (
        rows.select("run", "mark", "at")
        .join(_repeated(rows), "run")
        .groupBy("mark")
        .agg(F.collect_set("at").alias("runs"))
    )
    schema = pages.select("mark", "page_id", "url").schema.add("blocks", "binary")
    return (
        pages.mapInPandas(_block_rows, schema)
        .join(found, "mark", "left")
        .withColumn("decided", _decided("blocks", "runs"))
        .select(
            F.col("page_id").cast(kind).alias(key),
            F.col("url").alias(url),
            F.col("decided.text").alias("text"),
            F.length("decided.text").cast("long").alias("n_chars"),
            F.col("decided.n").alias("n_repeated"),
        )
    )
