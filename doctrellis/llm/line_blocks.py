"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element is a line; elements that can't be article text
(menus, forms, scripts, adverts, comments and so on, by tag, role, class or id) leave an empty
line in their place.  Inside an article, and for sections and headings, one word in a name is
not enough: a class or id has to be such a word, or to join it with one for a part of a page
(``share-buttons``, ``advert-box``), while ``related-work`` or ``discussion`` stays.  The block
length of a line is the summed text length of ``WINDOW`` lines from there, text of links left
out unless it lies in running text.  The main text starts where block lengths first surge above
``SURGE``, or at a headline from which lines of text lead there, and ends where they last dive to
nothing; lines of links in between are left out where they lie in a dive outside an article, and
one last line of an article is kept even if it is mostly a link.  Lines of an ``article`` or
``main`` element, if a page has any with text, count alone; without a surge in them they are the
main text as they are.

Null or empty html, and pages without such a region, give the empty text; repeated pages and
null ids are handled row by row; an empty table gives an empty table; other columns are not
read.  Broken markup never fails: open elements end with their parent, unknown tags are inline.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, mapped

WINDOW = 3  # lines of a block
SURGE = 86  # characters that start a main text
SCHEMA = "page_id long, url string, text string, n_chars long"

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody "
    "td template tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "aside audio button canvas dialog embed footer form head iframe input map menu nav noscript object search select svg "
    "template textarea title video".split()
)
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TEXT_TAGS = HEADINGS | {"article", "main", "section"}  # like all inside an article, known by whole class tokens only
#: Names that only comments have; the other words may name a part of an article as well.
COMMENT_NAMES = frozenset("comments commentlist disqus disqus_thread respond".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
BOILER_WORDS = frozenset(
    "ad ads adbox advert advertisement advertising adverts banner breadcrumb breadcrumbs consent cookie cookies copyright "
    "footer form gdpr legal login masthead menu nav navbar navigation newsletter notice pager pagination paywall popup privacy "
    "promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription teaser toolbar topbar widget".split()
)
#: With one of these a word in the name of an element inside an article tells what the element is.
PART_WORDS = frozenset(
    "area articles bar block box button buttons container content form group holder icons inner item items links list module outer panel "
    "posts section slot stories thread tools unit widget wrap wrapper".split()
)
BOILER_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)"
MARKUP = re.compile(OTHER + r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
UNQUOTED = re.compile(OTHER + r"([^>]*+)>", re.S)  # for what follows a quote that never ends
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def named(value: str, own: frozenset[str], is_class: bool) -> bool:
    """Whether a class or id inside an article is one of these words, or joins one with a word for a part."""
    for token in value.split():
        words = [w.lower() for w in WORDS.findall(token)]
        if token.lower() in own and is_class or len(words) > 1 and own & set(words) and PART_WORDS & set(words):
            return True
    return False


def verdict(tag: str, attributes: str, in_article: bool) -> str:
    """What an element's own tag and attributes say: keep, drop, or never (not even an article inside)."""
    if tag in ("html", "body"):
        return "keep"
    if tag in DROPPED or tag == "header" and not in_article:
        return "drop"
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            if in_article or tag in TEXT_TAGS:
                tokens = {t.lower() for t in value.split()}
                spoken = {w.lower() for w in WORDS.findall(value)} if tag not in TEXT_TAGS else set()
                if tokens & COMMENT_NAMES or spoken & COMMENT_NAMES or name == "class" and tokens & COMMENT_WORDS or named(value, COMMENT_WORDS, name == "class"):
                    return "never"
                if tag not in ("article", "main") and named(value, BOILER_WORDS, name == "class"):
                    return "drop"
                continue
            words = {w.lower() for w in WORDS.findall(value)}
            if words & COMMENT_WORDS:
                return "never"
            if words & BOILER_WORDS:
                return "drop"
        elif name == "role" and value.lower() in BOILER_ROLES:
            return "drop"
        elif name == "hidden" and value.lower() != "false" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return "never"
        elif name == "aria-hidden" and value.lower() == "true":
            return "drop"
    return "keep"


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, length of its links, inside an article, is a headline) of each block element in page order; each dropped element is one empty line.

    Takes time in proportion to the page: how often a tag is open is counted, and a quote that
    never ends is met once.
    """
    lines, parts, linked = [], [], [0]
    stack: list[tuple[str, str, bool]] = []  # tag, verdict, inside an article
    open_tags: Counter[str] = Counter()
    blocky: list[int] = []  # places in the stack of elements that others may close

    def flush(gap: bool = False) -> None:
        text = " ".join(references.unescape("".join(parts)).split())
        if text or gap:
            lines.append((text, linked[0], bool(stack) and stack[-1][2], bool(text) and bool(stack) and any(open_tags[h] for h in HEADINGS)))
        parts.clear()
        linked[0] = 0

    def take(text: str) -> None:
        state = stack[-1][1] if stack else "keep"
        if state == "keep" and text:
            parts.append(text)
            if open_tags["a"]:
                linked[0] += len(text)

    def leave(count: int) -> None:
        for _ in range(count):
            root = stack[-1][1] != "keep" and (len(stack) < 2 or stack[-2][1] == "keep")
            if root or stack[-1][0] in BLOCKS:
                flush(root)
            open_tags[stack.pop()[0]] -= 1
            if blocky and blocky[-1] == len(stack):
                blocky.pop()

    at, last, markup = 0, page.rfind(">"), MARKUP
    while True:
        begin = page.find("<", at)
        if begin < 0 or begin > last and not page.startswith("<!--", begin):
            # no tag ends beyond here; a comment may still begin
            tail = page.find("<!--", at)
            take(page[at:tail if tail >= 0 else len(page)])
            break
        found = markup.match(page, begin)
        if not found and page[begin + 1:begin + 2].isalpha() or not found and page[begin + 1:begin + 2] == "/":
            markup = UNQUOTED
            found = markup.match(page, begin)
        if not found:
            take(page[at:begin + 1])
            at = begin + 1
            continue
        take(page[at:begin])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if open_tags[tag]:
                leave(next(n for n, t in enumerate(reversed(stack), 1) if t[0] == tag))
            elif tag in BLOCKS:
                flush()
            continue
        while blocky and tag in CLOSED_BY.get(stack[blocky[-1]][0], ()):
            leave(len(stack) - blocky[-1])
        if tag == "a" and open_tags["a"]:
            leave(next(n for n, t in enumerate(reversed(stack), 1) if t[0] == "a"))
        outer, inside = (stack[-1][1], stack[-1][2]) if stack else ("keep", False)
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            else:
                take(" " if tag == "br" else "")
            continue
        own = verdict(tag, found[3], inside)
        state = own if outer == "keep" or own == "never" else outer
        if outer == "drop" and own == "keep" and tag in ("article", "main"):
            state = "keep"
        if tag in BLOCKS or state != "keep" and outer == "keep":
            flush()
        inside = state == "keep" and (inside or tag in ("article", "main"))
        if tag in RAW or tag == "plaintext":
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if state == "keep" and tag not in ("script", "style"):
                flush()
            continue
        if found[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in CLOSED_BY or tag in BLOCKS:
            blocky.append(len(stack))
        stack.append((tag, state, inside))
        open_tags[tag] += 1
    leave(len(stack))
    flush()
    return lines


def regions(lengths: list[int], surge: int, window: int) -> list[tuple[int, int]]:
    """Line ranges between a surge of the block lengths and the next dive to nothing."""
    n = len(lengths)
    blocks = [sum(lengths[i:i + window]) for i in range(n)]
    found, i = [], 0
    while i < n:
        if lengths[i] and blocks[i] >= surge:
            end = i
            while end < n and blocks[end]:
                end += 1
            found.append((i, end))
            i = end
        else:
            i += 1
    return found


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines from the first surge, or the headline before it, to the last dive."""
    if not page:
        return ""
    lines = lines_of(page)
    article = any(text and inside for text, _, inside, _ in lines)
    own = [bool(text) and (inside or not article) for text, _, inside, _ in lines]
    lengths = [len(text) if o and 3 * links <= len(text) else 0 for (text, links, _, _), o in zip(lines, own)]
    ranges = regions(lengths, surge, window)
    if not ranges:
        return "\n".join(text for text, _, inside, _ in lines if text and inside)
    start, end = ranges[0][0], ranges[-1][1]
    if article:
        start = next((i for i in range(start) if own[i] and lines[i][3]), start)
        after = [i for i in range(end, len(lines)) if own[i]]
        end = after[0] + 1 if len(after) == 1 else end
    else:
        i = start
        while i and lengths[i - 1]:
            i -= 1
            start = i if lines[i][3] else start
    within = {i for a, b in ranges for i in range(a, b)}
    return "\n".join(lines[i][0] for i in range(start, end) if own[i] and (article or lengths[i] or i in within))


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, main text and its length in characters of every page."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            texts = [main_text(x, window, surge) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return mapped(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), SCHEMA, work)
