"""Main text of web pages by a maximum-scoring run of tokens.

A page is a row of tokens.  Words score positive, the more the likelier words of their section
are content; tags score negative, the more the likelier their section is not.  Both weights come
from pages that label their content themselves (``article`` or ``main``).  One linear scan finds
the run of tokens with the greatest sum; what lies in it, without menus, adverts, forms and the
like inside, is the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Labelled pages that weights are learned from, about as many.
SAMPLE_PAGES = 300

# Element names of HTML by their role.
RAW = "script style noscript template textarea title svg math iframe object canvas select datalist".split()
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul"
).split()
SECTIONS = "article aside body dialog div footer form header main nav search section".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BOILERPLATE = "aside button dialog footer form head input label menu nav search".split()
NAMES = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "discussion feedback masthead menu nav navbar navigation newsletter notice notices pagination popup promo related replies reply "
    "respond responses review reviews share sharing sidebar social sponsor sponsored subscribe toolbar"
).split()
# Words of class names that say nothing about the content.
NEUTRAL = (
    "area block body bottom box btn button buttons card col column container content cta foot head header holder icon icons inner item "
    "items left link links list module outer panel post posts reader readers right row section side site slot text top unit user users "
    "widget widgets wrap wrapper"
).split()
CONTENT = ("article", "main")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^>]*[\s\"'])?/>|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>(?:[^<]++|<(?![a-zA-Z!?/]))++)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Token:
    """A tag (``text`` empty) or the text between two tags, with the section it stands in."""

    tag: str
    text: str
    words: int
    section: str
    skipped: bool
    block: int
    labelled: bool


@dataclass
class Names:
    """What the words of class, id and role say: negative for boilerplate, positive for content.

    The fixed list is where learning begins, ``PRIOR`` elements of each of its words outside
    content; labelled pages count on from there.  Neutral words say nothing.
    """

    inside: Counter = field(default_factory=Counter)
    outside: Counter = field(default_factory=Counter)

    def word(self, word: str) -> float:
        good, bad = self.inside[word] + 1.0, self.outside[word] + 1.0 + (PRIOR if word in _LISTED else 0)
        known = word in _LISTED or self.inside[word] + self.outside[word] >= PRIOR
        return math.log(good / bad) if known else 0.0 if word in _NEUTRAL else UNKNOWN

    def worth(self, parts: set[str]) -> float:
        return sum(self.word(p) for p in parts)


# Pages' worth of belief in the fixed list, and what a word that was hardly met speaks for content.
PRIOR = 8
UNKNOWN = math.log(PRIOR + 1)
_LISTED, _NEUTRAL = frozenset(NAMES), frozenset(NEUTRAL)


def tokens(page: str, by_name: bool = True, names: Names | None = None) -> list[Token]:
    """The tokens of a page in order; comments, scripts, styles and the like are not among them.

    Open elements are tracked as browsers do for the cases that occur: void elements never
    open, a block closes an open paragraph, an end tag closes what is open inside its element,
    and one without a start is ignored.

    With ``by_name`` the class, id or role of an element can make it boilerplate.  That does not
    reach into an article or main element that it holds, unless it stands in one itself.
    """
    names = names or Names()
    out: list[Token] = []
    stack: list[tuple[str, str, bool, bool, bool]] = []  # name, section, boilerplate, labelled, boilerplate by element
    block = 0
    for m in _TOKEN.finditer(page):
        section, skipped, labelled = stack[-1][1:4] if stack else ("", False, False)
        if m["text"] is not None:
            text = html.unescape(m["text"])
            out.append(Token("", text, len(text.split()), section, skipped, block, labelled))
            continue
        if m["name"] is None:
            continue
        name, closes = m["name"].lower(), bool(m["close"])
        if name in BLOCKS:
            block += 1
        if closes:
            out.append(Token("/" + name, "", 0, section, skipped, block, labelled))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in BLOCKS and stack and stack[-1][0] != "p":
            for k in range(len(stack) - 1, -1, -1):  # inline elements left open in a paragraph end with it
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        elif name in BLOCKS and stack:
            stack.pop()
        section, skipped, labelled, sure = stack[-1][1:] if stack else ("", False, False, False)
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(m["attrs"] or "")).lower()
        parts = set(_PARTS.findall(named))
        sure = sure or name in BOILERPLATE or (name == "header" and not labelled)
        if name in CONTENT and not labelled:
            skipped = sure
        # An article inside content may be a comment; the outermost one is the content.
        aside = sure or by_name and name not in ("html", "body") and (labelled or name not in CONTENT) and names.worth(parts) < 0
        key = f"{name}.{'.'.join(sorted(parts))}" if parts else name
        if name in SECTIONS:
            section = key
        out.append(Token(name if not parts else key, "", 0, section, skipped or aside, block, labelled))
        if name not in VOID and not (m["attrs"] or "").endswith("/"):
            stack.append((name, section, skipped or aside, labelled or name in CONTENT, sure))
    return out


@dataclass
class Weights:
    """Worth of a word and cost of a tag in each section; what is not known is worth what ``other`` says."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    names: Names = field(default_factory=Names)
    other_word: float = 0.6
    other_tag: float = 0.15
    left_out_tag: float = 1.0

    def score(self, token: Token) -> float:
        if not token.tag:
            return (0.02 if token.skipped else self.words.get(token.section, self.other_word)) * token.words
        if token.skipped and token.labelled:
            return -self.other_tag
        return -self.tags.get(token.section, self.left_out_tag if token.skipped else self.other_tag)


def learned(pages: list[str]) -> Weights:
    """Weights from labelled pages.

    A word is worth the share of its section's words that are content.  A tag costs a tenth
    of a word, and in a section without content as much as the longest usual run of words
    outside, so that no such run is worth the way to it.
    """
    words, good_words, tags, good_tags = Counter(), Counter(), Counter(), Counter()
    runs: list[int] = []
    names = learned_names(pages)
    for page in pages:
        run = 0
        for t in tokens(page, names=names):
            good = t.labelled and not t.skipped
            if t.tag:
                tags[t.section] += 1
                good_tags[t.section] += good
                run = 0
            else:
                words[t.section] += t.words
                good_words[t.section] += t.words * good
                run = 0 if good else run + t.words
                runs.append(run)
    runs.sort()
    far = max(10, runs[int(0.99 * (len(runs) - 1))]) if runs else 10
    worth = {s: (good_words[s] + 0.6) / (n + 1) for s, n in words.items()}
    cost = {s: 0.1 + far * ((n - good_tags[s] + 0.05) / (n + 1)) ** 2 for s, n in tags.items()}
    return Weights(worth, cost, names)


def learned_names(pages: list[str]) -> Names:
    """For each word of class names the pages that use it inside labelled content, and outside.

    What stands inside content by its element, such as an aside there, counts as outside.
    """
    names = Names()
    for page in pages:
        met: dict[str, set[bool]] = {}
        for t in tokens(page, by_name=False):
            for word in t.tag.split(".")[1:]:
                met.setdefault(word, set()).add(t.labelled and not t.skipped)
        for word, places in met.items():
            names.inside[word] += True in places
            names.outside[word] += False in places
    return names


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and one behind the last of the run with the greatest sum; the first of equals, (0, 0) if none is positive."""
    best, at, found = 0.0, 0, (0, 0)
    total = 0.0
    for k, score in enumerate(scores):
        if total <= 0:
            total, at = 0.0, k
        total += score
        if total > best:
            best, found = total, (at, k + 1)
    return found


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best run, one to a line; names do not count where they would leave no word."""
    return run_text(tokens(page, names=weights.names), weights) or run_text(tokens(page, by_name=False), weights)


def run_text(row: list[Token], weights: Weights) -> str:
    first, last = best_run([weights.score(t) for t in row])
    # The run begins and ends at words; the rest of their blocks belongs to it.
    while 0 < first < last and row[first - 1].block == row[first].block and not row[first - 1].skipped:
        first -= 1
    chosen = _between(row, first, last)
    blocks: dict[int, list[str]] = {}
    for t in (row[k] for k in chosen):
        if t.tag in ("br", "wbr") and not t.skipped:
            blocks.setdefault(t.block, []).append(" " if t.tag == "br" else "")
        elif not t.tag and not t.skipped:
            blocks.setdefault(t.block, []).append(t.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _between(row: list[Token], first: int, last: int) -> list[int]:
    """The places of a run, with a heading right before labelled content and without what stands between two such parts."""
    labelled = [k for k in range(first, last) if row[k].labelled and not row[k].skipped]
    if not labelled:
        return list(range(first, last))
    inner = range(labelled[0], labelled[-1] + 1)
    chosen = [k for k in range(first, last) if row[k].labelled or k not in inner]
    # Back over tags and white space to the end tag of a heading, and on to its start.
    k = end = first - 1
    while k >= 0 and (row[k].tag or not row[k].words) and row[k].tag != "/h1":
        k -= 1
    if k >= 0 and row[k].tag == "/h1" and not row[k].skipped:
        while k >= 0 and row[k].tag.split(".")[0] != "h1":
            k -= 1
        if k >= 0:
            chosen = [*range(k, end + 1), *chosen]
    return chosen


def page_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = SAMPLE_PAGES) -> Weights:
    """Weights from about ``most`` labelled pages, drawn by the hashes of their ids."""
    labelled = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.col("html").rlike("(?i)<(article|main)\\b"))
    return learned([r["html"] for r in common.drawn(labelled, most, "id").collect()])


def extracted(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page, and one without any words in its best run, has an empty text.
    Repeated rows give repeated results.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or page_weights(pages, id_col, html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), shared.value) for x in batch.column(2)]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(read, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
