"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags.  A word scores by how labelled pages use words that stand as
it does (plain, linked or in a headline; inside or outside of the page's article), a tag by how they
use that tag.  One linear scan finds the contiguous run of highest score: the main text lies in it.
Where most words of a page stand in its article or main elements the scan alone decides what around
them goes; the lists of elements and names below take boilerplate out of the run and, in pages
without such elements, out of what is scored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volscreen.llm.common import table, text_blocks, tidy

# Fixed values of HTML: elements that never hold article text, and those that do not end a block.
_NEVER = set("nav footer aside form script style noscript iframe svg button select template head dialog menu".split())
_INLINE = set(
    "a abbr b bdi bdo br cite code data dfn em font i img ins kbd mark q s samp small span strong sub sup time tt u var wbr".split()
)
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_HINT = re.compile(
    r"(?:^|[\s_-])(ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|cookies?|consent|notice|newsletter|subscribe|sidebar|"
    r"menu|nav(?:bar|igation)?|breadcrumbs?|header|footer|masthead|share|social|related|recommended|comments?|disqus|replies|widget|popup|modal)(?=$|[\s_-])",
    re.I,
)
# Names that hold a hint without being boilerplate: states of a wrapper, headers of an article.
_STATE = re.compile(r"(?:^|[_-])(?:has|no|not|with|without|show|hide)[_-]", re.I)
_HEADS = {"header", "masthead"}
_HEADED = re.compile(r"(?:^|[_-])(?:article|entry|post|story)(?:$|[_-])", re.I)
_MAIN = {"article", "main"}
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words beside a hint in the id of a section that is boilerplate; with other words it is an anchor.
_LISTS = set("area articles bar block body bottom box container content form inner items left links list outer posts right row section slot stories thread top unit wrap wrapper".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|noscript|template|iframe|svg|textarea)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*+>"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

#: Labelled pages: the parts between the braces are content.
LABELLED = (
    '<body><nav><ul><li><a href="/a">home</a></li><li><a href="/b">news of today</a></li></ul></nav><div class="ad">buy our shoes now</div>'
    "{<article><h1>the river rose</h1><p>after three days of rain the river rose by <b>two</b> metres</p><p>nobody was hurt in the valley said the mayor</p></article>}"
    "<footer>all rights reserved by the valley news</footer></body>",
    '<body><header><a href="/">site</a><a href="/x">about us</a></header><div id="content">{<h2>on bread</h2><p>flour water and salt are all that it takes</p>'
    "<p>knead it long and wait<br>then bake it hot</p><ul><li>flour</li><li>water</li></ul>}</div>"
    '<div class="comments"><p>nice one</p><p>thanks for this</p></div><div class="sidebar"><a href="/1">more</a><a href="/2">even more</a></div></body>',
    '<body><div><a href="/l">log in</a><a href="/s">sign up</a></div><main>{<h1>a walk</h1><p>we left at dawn and met no one until noon</p>'
    '<blockquote>the hills are quiet</blockquote><p>then came the <a href="/m">marsh</a> and the long way back</p>}</main>'
    '<form><input name="q"><button>search the site</button></form><div><a href="/t">terms</a><a href="/p">privacy</a></div></body>',
    '<body><div class="top">welcome guest you are not signed in</div>{<h1>the last ferry</h1><article><p>it left the pier at ten past nine with four cars and a dog on board</p>'
    '<p>no one waved and the <a href="/c">captain</a> kept his eyes on the far shore</p>'
    '<p>by noon the bridge was open and the pier had been sold to a man from the city who means to serve coffee there</p></article>}<div class="legal">prices may change at any time without a word from us</div>'
    '<div>printed on paper by the island press</div></body>',
    '<body><div class="x1">the weather today is mild with some cloud in the west</div><main><p>{<b>salt</b> is older than any road that carries it</p>'
    '<p>men walked for weeks to trade a bag of it for a bag of grain</p>'
    '<p>towns that stood on it grew rich and towns that lay far from it paid what they were asked and learned to be polite</p><ul><li>sea salt</li><li>rock salt</li></ul>}</main>'
    '<div class="x2"><a href="/1">ten ways to sleep</a><a href="/2">why cats stare</a></div><div class="x3">we use your data to make this site better for you</div></body>',
    '<body><div class="top">call us now</div><div class="text">{<div><h1>how to mend a net before the tide turns</h1></div><div><p>lay it flat in good light and find the first whole knot above the hole</p>'
    '<p>cut the loose ends away then tie from knot to knot until the hole is closed</p></div><div><p>see the <a href="/k">list of knots</a> for names</p></div>}</div>'
    '<div class="end"><a href="/a">about the club</a><a href="/j">join us</a></div></body>',
)


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    """Whether the class, id or role of an element (``inside`` an article or main) names boilerplate."""
    for kind, value in _NAME.findall(attrs):
        value = value.strip("\"'")
        if not _HINT.search(value) or (kind.lower() == "id" and tag in _HEADINGS):
            continue
        for name in value.split():
            hints = {h.lower() for h in _HINT.findall(name)}
            if inside or tag in _HEADINGS or _HEADED.search(name):
                hints -= _HEADS
            if not hints or _STATE.search(name):
                continue
            # inside an article a name with other words beside the hint is an anchor or a topic ("notice-period")
            if inside and not {x for x in re.split("[_-]+", name.lower()) if not x.isdigit()} <= hints | _LISTS:
                continue
            return True
    return False


def _region(stack: list[tuple[str, bool, int]]) -> int | None:
    """The outermost article or main, else the element that holds the block (none if that is the body)."""
    outer = next((n for t, _, n in stack if t in _MAIN), None)
    if outer is not None:
        return outer
    blocks = [s for s in stack if s[0] not in _INLINE]
    return blocks[-2][2] if len(blocks) > 1 and blocks[-2][0] not in ("html", "body") else None


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool, int | None, bool, bool]]:
    """(kind, value, dropped, linked, region, inside, headline) of every token.

    Kind is tag, end or text; dropped parts are in what the lists name boilerplate, inside ones in an
    article or main, headlines in an h1.
    """
    stack: list[tuple[str, bool, int]] = []
    links = 0  # open a elements
    for m in _TOKEN.finditer(page):
        text, tag = m["text"], m["tag"]
        dropped = bool(stack) and stack[-1][1]
        if text is not None:
            names = {t for t, *_ in stack}
            region = None if dropped or text.isspace() else _region(stack)
            yield "text", text, dropped, links > 0, region, not names.isdisjoint(_MAIN), "h1" in names
        elif tag is not None:
            tag = tag.lower()
            if m["end"]:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if at is not None:
                    links -= sum(s[0] == "a" for s in stack[at:])
                    del stack[at:]
                yield "end", tag, dropped, False, None, any(s[0] in _MAIN for s in stack), False
                continue
            if tag in _MAIN or tag == "body":
                stack = [s for s in stack if not s[1]]
                links = sum(s[0] == "a" for s in stack)
                dropped = False
            elif tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()
                dropped = bool(stack) and stack[-1][1]
            inside = any(s[0] in _MAIN for s in stack)
            own = tag in _NEVER or (tag == "header" and not inside) or (
                tag not in ("html", "body", "article", "main") and _boilerplate(tag, m["attrs"], inside)
            )
            yield "tag", tag, dropped or own, False, None, inside, False
            if tag not in _VOID and not m["attrs"].endswith("/"):
                stack.append((tag, dropped or own, m.start()))
                links += tag == "a"


def _focused(page: list[tuple]) -> bool:
    """Whether at least half of the words that no list drops stand in an article or main."""
    n = {True: 0, False: 0}
    for kind, value, dropped, _, _, inside, _ in page:
        if kind == "text" and not dropped:
            n[inside] += len(value.split())
    return n[True] > 0 and n[True] >= n[False]


def _scored(page: list[tuple], focused: bool) -> Iterator[tuple[tuple, str | tuple[str, str] | None]]:
    """Each token with the key of its weight; None for tokens that score nothing.

    Outside of the main elements of a focused page boilerplate is scored like all else there.
    """
    for token in page:
        kind, value, dropped, linked, _, inside, headline = token
        key = None
        if not dropped or (focused and not inside):
            if kind == "text":
                place = "free" if not focused else "in" if inside else "out"
                key = ("link" if linked else "head" if headline and not dropped else "word", place)
            elif kind == "tag":
                key = "<" + value
        yield token, key


def fit(pages: tuple[str, ...] = LABELLED) -> dict[str | tuple[str, str], float]:
    """Log-odds of content from labelled pages: of words by kind and place, and of tags.

    Tags cost at least a little: a run of tags without words is never content.
    """
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for page in pages:
        focused, content = _focused(list(tokens(re.sub("[{}]", "", page)))), False
        for (kind, value, *_), key in _scored(list(tokens(page)), focused):
            if kind == "tag" and key:
                seen[content][key] += 1
            for part in re.split(r"([{}])", value) if kind == "text" else ():
                if part in ("{", "}"):
                    content = part == "{"
                elif key:
                    seen[content][key] += len(part.split())
    words = [(kind, place) for kind in ("word", "link", "head") for place in ("in", "out", "free")]
    odds = {k: math.log((seen[True][k] + 0.5) / (seen[False][k] + 0.5)) for k in {*words, *seen[True], *seen[False]}}
    return {k: v if k in words else min(-0.1, v - 1) for k, v in odds.items()}


def best_run(scores: list[float], regions: list[int | None]) -> tuple[int, int]:
    """The contiguous run of highest score, by one scan; (0, 0) where none is above zero.

    What stands between two positive scores of one region (not None) costs nothing, so it cannot part them.
    """
    best, best_at, run, begin = 0.0, (0, 0), 0.0, 0
    held: dict[int, tuple[float, int]] = {}  # the run up to the last positive score of each region
    for i, (s, region) in enumerate(zip(scores, regions, strict=True)):
        if run <= 0:
            run, begin = 0.0, i
        if s > 0 and region in held:
            run, begin = max((run, begin), held[region], key=lambda x: (x[0], -x[1]))
        run += s
        if s > 0 and region is not None:
            held[region] = (run, begin)
        if run > best:
            best, best_at = run, (begin, i + 1)
    return best_at


def extract(page: str, weights: dict) -> str:
    """The text of a page: blocks joined by two line feeds.

    A region is all that stands in articles and mains of a focused page, else an article or main or the
    blocks side by side in one element.
    """
    parsed = list(tokens(page))
    focused = _focused(parsed)
    blocks: list[list[str]] = [[]]
    scores: list[float] = []
    block_of: list[int] = []
    regions: list[int | None] = []
    for (kind, value, dropped, _, region, inside, _), key in _scored(parsed, focused):
        if kind == "text":
            n = len(value.split())
            if n and key:
                scores.append(n * weights[key])
                block_of.append(-1 if dropped else len(blocks) - 1)
                regions.append(region if not focused else 0 if inside else None)
            if not dropped:
                blocks[-1].append(value)
            continue
        if key:
            scores.append(weights.get(key, -1.0))
            block_of.append(-1)
            regions.append(None)
        if value not in _INLINE:
            if blocks[-1]:
                blocks.append([])
        elif value == "br" and not dropped:
            blocks[-1].append(" ")
    hit = dict.fromkeys(b for b in block_of[slice(*best_run(scores, regions))] if b >= 0)
    found = (" ".join(_html.unescape("".join(blocks[b])).split()) for b in hit)
    return "\n\n".join(t for t in found if t)


def extract_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    A null or empty page has an empty text.  Nulls in the other columns stay; repeated rows give
    repeated rows; very long pages are read whole; extra columns are not read; an empty table gives an
    empty one.
    """
    weights = fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(2).to_pylist()
            for lo, hi in text_blocks(pages):
                out = [extract(p or "", weights) for p in pages[lo:hi]]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[:2]), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
