"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block by itself: density of
stop words, length and density of links make it good or bad; short blocks, and longer ones that are
neither wordy nor linked enough, stay open. What is written in menus, headers, footers, sidebars,
notices, adverts, forms and comments can read like any other text, so there markup outweighs a density
that speaks for a block; an article's tags decide nothing in this pass. A form, fieldset or dialog that
holds more than half of a page's good text is no furniture but a wrapper, and loses that weight. In the
second pass open blocks take the label of the nearest decided neighbours within their own container:
that of both if they agree, else of the nearer one. Where a container has no decided block, being in an
article speaks for the text; otherwise neighbours beyond the container decide, and on a page without
any good block open ones without links are the text: so it is in languages whose stop words aren't
listed, where markup and links decide alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.llm._arrow import slices, with_columns
from pipewright.llm._tables import table

#: Limits in characters, and shares of words or characters. The stop words below are few, so their
#: density in running text is lower than with full lists.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.12
FEW_LINKED, MOST_LINKED = 0.2, 0.5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its
    just like more most my no not of on one only or other our out she so some than that the their them then there these they this to up was we were
    what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer eines er es für hat ich ihr im in ist ja
    kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wird wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou où par
    pas plus pour qu que qui sa sans se ses son sont sur ta te tu un une vos votre vous
    al como con de del desde donde el ella ellos en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque que se
    ser si sin sobre son su sus también un una uno y ya""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3
    h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements whose content isn't text of the page, read up to their end tag whatever is inside.
RAW_TAGS = ("script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "select", "noframes")
#: Elements that hold blocks which belong together; text directly in the body has the whole page around it.
CONTAINERS = frozenset("article aside center dialog div fieldset footer form header main menu nav section table td".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_TAGS = frozenset("nav header footer aside form menu button dialog fieldset".split())
#: Those of them that can be around a whole page, and names of headings, which are an article's own inside it.
WRAPPERS, HEADINGS = frozenset(("form", "fieldset", "dialog")), frozenset(("header", "masthead"))
IN_TAGS = frozenset(("article", "main"))
#: Words of class, id and role that tell what an element holds; they count if the name has no others but those of PLAIN_WORDS.
OUT_WORDS = frozenset(
    """ad ads adbox advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie
    cookies copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo
    promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split()
)
PLAIN_WORDS = frozenset(
    """area bar block bottom box button buttons container content global group inner item items left link links list main outer page primary right
    secondary section site slot text thread top user wrap wrapper""".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # a self-closed drawing or formula; a slash that ends an unquoted value closes nothing
    r"""|<(?:svg|math)(?=[\s/])(?>"[^"]*"|'[^']*'|=\s*[^\s"'>]+|[^>"'/]|/(?!>))*+/>"""
    rf"|<({'|'.join(RAW_TAGS)})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("linked", "place", "region", "text", "wrappers")

    def __init__(self, text: str, linked: int, place: str, region: int, wrappers: tuple[int, ...]):
        self.text, self.linked, self.place, self.region, self.wrappers = text, linked, place, region, wrappers


def _is_out(name: str, attributes: str, place: str) -> bool:
    if name in OUT_TAGS:
        return not (name == "header" and place == "in")  # an article's own heading
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for value in _NAMES.findall(attributes):
        for one in value.strip("\"'").lower().split():
            parts = {x for x in re.split(r"[^a-z]+", one) if x}
            own = parts & OUT_WORDS
            if own and parts <= OUT_WORDS | PLAIN_WORDS and not (place == "in" and own <= HEADINGS):
                return True
    return bool(_HIDDEN.search(attributes))


def blocks(html: str) -> Iterator[Block]:
    """Blocks with text, in page order: text, characters inside links, place ('out', 'in' or ''), number of the innermost container, and those of the forms and the like around."""
    parts: list[str] = []
    linked, in_link, at, regions = 0, 0, 0, 0
    top: tuple[str, str, int, tuple[int, ...]] = ("", "", 0, ())
    stack: list[tuple[str, str, int, tuple[int, ...]]] = []  # open elements that matter, with the place, region and wrappers they make
    opened: Counter[str] = Counter()

    def flush() -> Iterator[Block]:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            _, place, region, wrappers = stack[-1] if stack else top
            yield Block(text, min(linked, len(text)), place, region, wrappers)
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(" ".join(unescape(text).split()))

    def close(name: str) -> None:
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    for token in _TOKEN.finditer(html):
        add(html[at : token.start()])
        at = token.end()
        name = (token[3] or token[6] or "").lower()
        if not name:
            continue
        closing, attributes = (token[2], token[4]) if token[3] else (token[5], token[7])
        _, here, region, wrappers = stack[-1] if stack else top
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            add(" ")
            continue
        if name not in BLOCK_TAGS and name not in OUT_TAGS:
            if closing or name in VOID_TAGS or not attributes or not _is_out(name, attributes, here):
                if closing and opened[name]:
                    yield from flush()
                    close(name)
                continue
        yield from flush()
        in_link = in_link if name == "a" else 0
        if closing:
            if opened[name]:
                close(name)
            continue
        if stack and stack[-1][0] == "p":
            close("p")
            _, here, region, wrappers = stack[-1] if stack else top
        out = _is_out(name, attributes, here)
        if name in VOID_TAGS or name == "p" and not out:
            continue
        soft = out and name in WRAPPERS and not _is_out("div", attributes, here)
        if here != "out":
            here = "out" if out and not soft else "in" if name in IN_TAGS else here
        if not attributes.rstrip().endswith("/"):
            if name in CONTAINERS or out:
                regions += 1
                region = regions
            stack.append((name, here, region, (*wrappers, region) if soft else wrappers))
            opened[name] += 1
    add(html[at:])
    yield from flush()


def _first_pass(block: Block) -> str:
    """'good', 'bad' or 'open', by densities."""
    links = block.linked / len(block.text)
    if links > MOST_LINKED or "©" in block.text and len(block.text) < SHORT and block.place != "in":
        return "bad"
    if len(block.text) < SHORT or links > FEW_LINKED:
        return "open"
    words = _WORD.findall(block.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return "good" if stop >= STOP_HIGH or stop >= STOP_LOW and len(block.text) > LONG else "open"


def _nearest(first: list[str], wanted: list[int]) -> dict[int, str]:
    """Of each open block among ``wanted`` (ascending) the label of the nearest decided ones before and after; nothing where there are none."""
    near: dict[int, list[tuple[int, str]]] = {}
    for order in (wanted, wanted[::-1]):
        last = None
        for i in order:
            if first[i] != "open":
                last = i
            elif last is not None:
                near.setdefault(i, []).append((abs(i - last), first[last]))
    return {i: min(x, key=lambda d: (d[0], d[1] != "good"))[1] for i, x in near.items()}


def furniture(found: list[Block], first: list[str]) -> list[bool]:
    """Whether each block stands in what markup calls furniture; a wrapper of over half of the good text is none."""
    good = [(len(b.text), b.wrappers) for b, x in zip(found, first, strict=True) if x == "good" and b.place != "out"]
    held: Counter[int] = Counter()
    for size, wrappers in good:
        for w in wrappers:
            held[w] += size
    total = sum(size for size, _ in good)
    return [b.place == "out" or any(2 * held[w] <= total for w in b.wrappers) for b in found]


def labels(found: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text."""
    first = [_first_pass(b) for b in found]
    out = furniture(found, first)
    first = ["bad" if o else x for o, x in zip(out, first, strict=True)]  # markup outweighs densities
    regions: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if b.region and not out[i]:
            regions.setdefault(b.region, []).append(i)
    label: dict[int, str] = {}
    for own in regions.values():
        label |= _nearest(first, own)
    label |= {i: "good" for i, b in enumerate(found) if first[i] == "open" and i not in label and b.place == "in"}
    if "good" in first:
        label = _nearest(first, list(range(len(found)))) | label
    return [(label.get(i, "bad" if b.linked else "good") if first[i] == "open" else first[i]) == "good" for i, b in enumerate(found)]


def main_text(html: str | None) -> str:
    found = list(blocks(html or ""))
    return "\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html column, with ``text``: the main text of each page, blocks joined by line feeds.

    A null or empty html, and a page without main text, gives an empty text. Broken markup is read
    as far as it goes: unclosed elements end with those around them, and a comment or script without
    an end runs to the end of the page. Rows are handled one by one, so repeated rows and pages of
    any length are no special case; an empty table gives an empty result. A column of pages called
    text is replaced.
    """
    keep = [c for c in pages.columns if c not in (html, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            yield with_columns(batch, keep, {"text": pa.array([main_text(h) for h in batch.column(html).to_pylist()], pa.string())})

    out = pages.select(*keep, html)
    return out.mapInArrow(run, T.StructType([*out.select(*keep).schema.fields, T.StructField("text", T.StringType())]))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages. A null or empty html gives an empty text; repeated rows are read each; an empty table gives an
    empty result."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: Right for pages whose text is what stands in their one article, without anything in it that has to go.
OP8_SQL = r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_replace(regexp_extract(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?s)<article[^>]*>(.*)</article>', 1), '\s+', ' ', 'g') AS h FROM pages),
lines AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(h, '<br[^>]*>', ' ', 'g'), '</?(p|h[1-6]|ul|ol|li|div|section)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS parts FROM inner_html),
decoded AS (
  SELECT page_id, url, list_transform(parts, lambda p: trim(regexp_replace(replace(replace(replace(replace(replace(replace(p, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM lines),
joined AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda p: p <> ''), chr(10)) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined
"""
