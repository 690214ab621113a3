"""Main-text extraction by a maximum-scoring contiguous region.

A page is read as a row of tokens: its words and its tags; only scripts, styles and what the page hides give none. Every token is scored by
the logarithm of how much more often its like stands inside than outside the main text of labelled pages: tags by their name, a word by
what it stands in: the landmark around it (menu, header, footer, form and so on, and whether that lies in an article), words of class, id
and role, a heading that begins reader comments or further reading, a link, and whether it stands beside the page's articles. One linear
scan finds the contiguous region with the greatest sum (the longest of equal ones), which is widened to the article or main that it
touches, else to the container around it, and to whole blocks. Words of the region that score below zero for what they stand in go where they
lie in an article or main, came in by widening, or stand between parts of the text. Links are scored as a whole: they tell lists of links from lists of the text. Character references are decoded once, white space inside a block
becomes one space, blocks are joined in page order by an empty line.

A null or empty page, or one without words, gives the empty text. An element ends with its end tag, with its parent's, or where the next
start tag implies its end (p, li, dt, dd, tr, td, option and so on); one without any of these ends with the page. A stray closing tag is ignored.
Very long pages take time and memory in proportion to their length. Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: Elements that stand in a line; every other element starts and ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text, and elements that tell what they hold.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math canvas object audio video".split())
LANDMARKS = frozenset("nav header footer aside form button select menu dialog fieldset article main".split())
#: Blocks that hold a page's main text where no article or main does.
CONTAINERS = frozenset("div section center td".split())
#: Words of class, id and role that may tell what an element is, and those among them that main texts carry as well.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright "
    "disclaimer disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promotion related replies reply respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
UNSURE = ("header", "legal", "login", "search", "social", "widget")
#: Words by which a short heading begins what readers or the site have added.
ADDED = frozenset("comment comments reply replies responses related newsletter advertisement sponsored".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Run(str):
    """A text run and what it stands in: features that are scored."""

    of: tuple[str, ...] = ()


def _hidden(name: str, attributes: str) -> bool:
    if name == "head":
        return True
    for k, v in _ATTR.findall(attributes) if attributes.strip() and name not in ("body", "html") else ():
        k, v = k.lower(), v.strip("\"'").lower()
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)):
            return True
    return False


def _features(name: str, attributes: str, around: tuple[str, ...]) -> tuple[str, ...]:
    """Features of what stands in an element: the innermost landmark, by whether it lies in an article, and the class words since."""
    if name in ("article", "main"):
        return (name,)
    if name in LANDMARKS:
        inside = any(f in ("article", "main") or f.endswith(" in article") for f in around)
        around = (*(f for f in around if ":" in f), f"{name} in article" if inside else name)
    if attributes.strip() and name not in ("body", "html"):
        found = {w for k, v in _ATTR.findall(attributes) if k.lower() in ("class", "id", "role") for w in MARKS.intersection(re.split(r"[^a-z0-9]+", v.strip("\"'").lower()))}
        around = (*around, *sorted({f"class:{w}" for w in found} - set(around)))
    return around


class _Open:
    """The open elements: an end tag, or a start tag that implies one, ends what stands inside it (the HTML rules of scopes)."""

    def __init__(self):
        self.names: list[str] = []
        self.shown: list[bool] = []  # whether a start tag was given
        self.of: list[tuple[str, ...]] = [()]  # features of what stands in each
        self.at: dict[str, list[int]] = {}  # places of each name
        self.marks = [(-1, -1, -1, -1, -1)]  # the innermost table, scope, list, end of an item's search, block

    def push(self, name: str, shown: bool, of: tuple[str, ...] = ()) -> None:
        k, kept = len(self.names), self.marks[-1]
        self.of.append(of)
        self.names.append(name)
        self.shown.append(shown)
        self.at.setdefault(name, []).append(k)
        self.marks.append(tuple(k if name in _BOUNDS[i] else kept[i] for i in range(4)) + (kept[4] if name in INLINE else k,))

    def cut(self, k: int) -> list[str]:
        """Close everything from place k on; the names of those shown, innermost first."""
        out = []
        while len(self.names) > k:
            name = self.names.pop()
            if self.shown.pop():
                out.append(name)
            self.at[name].pop()
            self.marks.pop()
            self.of.pop()
        return out

    def inner(self, names, bound: int) -> list[int]:
        """The innermost place of each name that lies in the scope."""
        low = self.marks[-1][bound]
        return [self.at[n][-1] for n in names if self.at.get(n) and self.at[n][-1] >= low]

    def starts(self, name: str) -> int:
        """From which place on a start tag closes."""
        found = [len(self.names)]
        if name in ("body", "html"):
            return 0
        if self.names and self.names[-1] == "head" and name not in ("meta", "link", "base"):
            found.append(len(self.names) - 1)
        if name in _IMPLIES:
            closed, bound = _IMPLIES[name]
            found += self.inner(closed, bound)
        if name in _ENDS_P:
            found += self.inner(("p",), 1)
        if name in HEADINGS and self.names and self.names[-1] in HEADINGS:
            found.append(len(self.names) - 1)
        return min(found)

    def ends(self, name: str) -> int | None:
        """The place that an end tag closes, or None for a stray one."""
        if name in ("body", "html"):
            return None
        found = self.inner(HEADINGS if name in HEADINGS else (name,), 0 if name in _TABLE else 2 if name == "li" else 1)
        return max(found, default=None)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TABLE = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
_SCOPE = frozenset("html table td th caption marquee applet".split())
_ENDS_P = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul".split()
)
#: Elements at which the search for an open item ends: all blocks but address, div and p.
_ITEM_END = (_ENDS_P | _SCOPE | _TABLE | frozenset("body button head html select".split())) - {"address", "div", "p", "hr"}
_BOUNDS = (frozenset(["table"]), _SCOPE, _SCOPE | {"ul", "ol", "menu"}, _ITEM_END)
#: Start tag -> the elements it closes, and the scope in which they are sought.
_IMPLIES = (
    {"li": (("li",), 3), "dt": (("dt", "dd"), 3), "dd": (("dt", "dd"), 3), "option": (("option",), 1), "optgroup": (("option", "optgroup"), 1)}
    | dict.fromkeys(("td", "th"), (("td", "th", "caption", "colgroup"), 0)) | {"tr": (("tr", "td", "th", "caption", "colgroup"), 0)}
    | dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), 0))
)
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}


def _heads_additions(out: list[tuple[str, str]]) -> bool:
    """Whether the heading that ends the tokens is a short one that begins what has been added."""
    words: list[str] = []
    for kind, value in reversed(out):
        if kind == "tag" and value in HEADINGS:
            break
        if kind == "text":
            words = re.findall(r"[^\W\d_]+", value.lower()) + words
    return len(words) <= 3 and bool(ADDED.intersection(words))


def tokens(page: str) -> list[tuple[str, str]]:
    """(kind, value): ('text', decoded Run), ('tag', name), ('end', name); without scripts, styles and what is hidden.

    Ends are balanced: implied ones stand where they take effect, and ('gap', name) stands for stray end tags and for what was left out.
    Elements that are open at the end of the page have no end.
    """
    out: list[tuple[str, str]] = []
    at, n, skip, opened = 0, len(page), -1, _Open()  # skip: place of the hidden element that is open

    def text(raw: str) -> None:
        run = Run(html.unescape(raw))
        run.of = opened.of[-1]
        out.append(("text", run))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        m = (_TAG.match(page, lt) or _LOOSE.match(page, lt)) if lt < n else None
        if lt > at and skip >= 0 and opened.names[-1] == "head" and not page[at:lt].isspace():
            opened.cut(len(opened.names) - 1)  # a text ends the head
            skip = skip if skip < len(opened.names) else -1
        if lt > at and skip < 0:
            text(page[at:lt])
        if lt == n:
            break
        if not m:  # a bare < is text
            end = page.find("<", lt + 1)
            end = n if end < 0 else end
            if skip < 0:
                text(page[lt:end] if end - lt > 1 or end < n else "<")
            at = end
            continue
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                found = _RAW_END[name].search(page, at)
                end = found.start() if found else n
                close = page.find(">", end)
                at = n if end == n or close < 0 else close + 1
            continue
        k = (opened.ends(name) if name not in VOID else None) if closing else opened.starts(name)
        if k is not None and not (closing and name in INLINE and opened.marks[-1][4] > k):
            closed = opened.cut(k)
            ended = 0 <= k <= skip
            for c in closed:
                if c in HEADINGS and c != "h1" and skip < 0 and _heads_additions(out):
                    opened.of[-1] = (*opened.of[-1], "heading:added")
                out.append(("end", c))
        else:  # stray, or the end of an inline element around open blocks, which stay open
            closed, ended = [], k is not None and k == skip
            if k is not None:
                own = set(opened.of[k + 1]) - set(opened.of[k])
                opened.of[k + 1 :] = [tuple(f for f in of if f not in own) for of in opened.of[k + 1 :]]
        if ended:
            skip = -1
            out.append(("gap", name))
        elif skip >= 0:
            if not closing and name not in VOID:
                opened.push(name, False)
            continue
        if closing:
            if not closed and not ended:
                out.append(("gap", name))
            continue
        if name not in VOID:
            hidden = _hidden(name, m[3])
            opened.push(name, not hidden, opened.of[-1] if hidden else _features(name, m[3], opened.of[-1]))
            if hidden:
                skip = len(opened.names) - 1
                out.append(("gap", name))  # it parts what stands before and after
                continue
        out.append(("tag", name))
    return _without_wide_forms(out)


def _without_wide_forms(seq: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A form that holds most words of a page is the page's frame, not a form."""
    words = [(len(v.split()), "form" in v.of) for kind, v in seq if kind == "text"]
    if 2 * sum(n for n, form in words if form) > sum(n for n, _ in words):
        for kind, v in seq:
            if kind == "text":
                v.of = tuple(f for f in v.of if f != "form")
    return seq


def _inside(run: str) -> bool:
    of = getattr(run, "of", ())
    return any(f in ("article", "main") or f.endswith(" in article") for f in of)


class Scores:
    """Score of each tag and of a word in what it stands in: log odds of standing inside the main text, from labelled pages."""

    def __init__(self, labelled: list[tuple[str, str, str]]):
        """labelled: what stands before the main text, the main text, and what stands after it."""
        inside, outside, seen, of_words = Counter(), Counter(), (Counter(), Counter()), [0, 0]
        for before, main, after in labelled:
            here = False
            seq = tokens(f"{before}\0{main}\0{after}")
            beside = any(kind == "text" and _inside(v) for kind, v in seq)
            for kind, value in seq:
                if kind == "text":
                    for k, part in enumerate(value.split("\0")):
                        here = not here if k else here
                        count, words = inside if here else outside, len(part.split())
                        plain = here or not any(":" in f for f in value.of)
                        count["word"] += words * plain  # others are explained by what they stand in
                        of_words[here] += words
                        for f in self._of(value, beside):
                            seen[here][f] += words
                elif kind == "tag":
                    (inside if here else outside)[value] += 1
        total = sum(inside.values()), sum(outside.values())
        self.of = {t: math.log(((inside[t] + 0.5) / (total[0] + 1)) / ((outside[t] + 0.5) / (total[1] + 1))) for t in {*inside, *outside}}
        words = of_words[1], of_words[0]
        # words score positive and markup negative, as far as the pages bear it out
        self.word = max(self.of.pop("word"), 0.1)
        # a tag that the main text may hold, or one never seen, doesn't outweigh a word; a link does
        self.other = -self.word / 2
        self.of = {t: min(max(s, self.other) if inside[t] and t != "a" else s, 0.0 if t in ("p", "article", "main", "h1") else -0.01) for t, s in self.of.items()}
        # what a word stands in can only speak against it
        self.features = {f: min(0.0, math.log(((seen[1][f] + 0.5) / (words[0] + 1)) / ((seen[0][f] + 0.5) / (words[1] + 1)))) for f in {*seen[0], *seen[1]}}
        # beside an article words count for little, not for less than nothing
        self.features["beside"] = max(self.features.get("beside", 0.0), 0.05 - self.word)
        self.unknown = min((s for f, s in self.features.items() if f.startswith("class:")), default=0.0)

    @staticmethod
    def _of(run: str, beside: bool) -> tuple[str, ...]:
        own = getattr(run, "of", ())
        return (*own, "beside") if beside and not _inside(run) else own

    def of_word(self, run: str, beside: bool) -> float:
        # what no labelled page shows in an article counts as it does elsewhere
        rare = lambda f: self.unknown if f.startswith("class:") else self.features.get(f.removesuffix(" in article"), 0.0)
        return self.word + sum(self.features[f] if f in self.features else rare(f) for f in self._of(run, beside))


def values(seq: list[tuple[str, str]], scores: Scores) -> list[float]:
    """Score of each token; a link's whole score, its words with its tag, stands at its first text, so that no region takes a part of it."""
    out, link, first = [], False, -1
    beside = any(kind == "text" and _inside(v) for kind, v in seq)
    for kind, value in seq:
        s = 0.0
        if kind == "text":
            n = len(value.split())
            s = scores.of_word(value, beside) * n if n else 0.0
            if link and first >= 0:
                out[first] += s
                s = 0.0
            elif link and s:
                first = len(out)
                s += scores.of.get("a", scores.other)
        elif value == "a":
            link, first = kind == "tag", -1
        elif kind == "tag" and value not in INLINE:
            s = scores.of.get(value, scores.other)
        out.append(s)
    return out


def region(seq: list[tuple[str, str]], scores: Scores) -> tuple[int, int]:
    """Start and end of the contiguous tokens with the greatest sum of scores."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(values(seq, scores)):
        if total <= 0 < s:
            total, start = 0.0, k
        total += s
        if total > best or (total == best and k + 1 - start > best_at[1] - best_at[0]):
            best, best_at = total, (start, k + 1)
    return best_at


def _spans(seq: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """Start, end and name of every element, inner ones before those around them."""
    spans, stack = [], []
    for k, (kind, name) in enumerate(seq):
        if kind == "tag" and name not in VOID:
            stack.append((k, name))
        elif kind == "end":
            start, own = stack.pop()
            spans.append((start, k + 1, own))
    return spans + [(start, len(seq), own) for start, own in reversed(stack)]


def widened(seq: list[tuple[str, str]], lo: int, hi: int) -> tuple[int, int]:
    """The region with the whole of every element of which it holds half the words, of every article or main that it touches, else of the innermost container around it."""
    while hi > lo and seq[hi - 1][0] != "text":
        hi -= 1
    if lo == hi:
        return lo, hi
    spans = [x for x in _spans(seq) if x[0] < hi and x[1] > lo and x[2] not in INLINE and x[2] not in ("html", "body")]
    words = [0, *accumulate(len(value.split()) if kind == "text" else 0 for kind, value in seq)]
    cut = [x for x in spans if (x[0] < lo < x[1] < hi) or (lo < x[0] < hi < x[1])]
    cut = [x for x in cut if 2 * (words[min(x[1], hi)] - words[max(x[0], lo)]) >= words[x[1]] - words[x[0]]]
    whole = cut + ([x for x in spans if x[2] == "article"] or [x for x in spans if x[2] == "main"])
    lo, hi = min([lo, *(x[0] for x in whole)]), max([hi, *(x[1] for x in whole)])
    if not any(x[2] in ("article", "main") for x in whole):
        around = next((x for x in spans if x[2] in CONTAINERS and x[0] <= lo and x[1] >= hi), None)
        lo, hi = around[:2] if around else (lo, hi)
    return lo, hi


def _left_out(seq: list[tuple[str, str]], scores: Scores, scanned: tuple[int, int], lo: int, hi: int) -> set[int]:
    """Text runs of the region whose words score below zero for what they stand in: inside an article, between other parts of the text, or where only widening took them in."""
    beside = any(kind == "text" and _inside(v) for kind, v in seq)
    texts = [k for k in range(lo, hi) if seq[k][0] == "text" and seq[k][1].strip()]
    low = [k for k in texts if getattr(seq[k][1], "of", ()) and scores.of_word(seq[k][1], beside) < 0]
    if not low:
        return set()
    kept = sorted(set(texts) - set(low))
    gone = {k for k in low if kept and (not scanned[0] <= k < scanned[1] or kept[0] < k < kept[-1] or _inside(seq[k][1]))}
    added = {k for k in gone if "heading:added" in seq[k][1].of}
    for start, end, name in _spans(seq) if added else ():
        after = bisect_left(texts, end)
        if name in HEADINGS and lo <= start and after < len(texts) and texts[after] in added and _heads_additions(seq[start : end - 1]):
            gone.update(k for k in texts if start < k < end)
    return gone


def extract(page: str | None, scores: Scores) -> str:
    seq = tokens(page or "")
    scanned = region(seq, scores)
    lo, hi = widened(seq, *scanned)
    block = lambda t: t[0] != "text" and t[1] not in INLINE
    while lo > 0 and not block(seq[lo - 1]):
        lo -= 1
    while hi < len(seq) and not block(seq[hi]):
        hi += 1
    gone = _left_out(seq, scores, scanned, lo, hi) if lo < hi else set()
    blocks, now = [], []
    for k, t in [*enumerate(seq[lo:hi], lo), (hi, ("end", ""))]:
        if block(t):
            if text := " ".join("".join(now).split()):
                blocks.append(text)
            now = []
        elif t[0] == "text":
            now.append(" " if k in gone else t[1])
        elif t[1] in ("br", "wbr", "img"):
            now.append(" ")
    return "\n\n".join(blocks)


_MENU = '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two words</a></li><li><a href="/c">Three</a></li></ul></nav>'
_FOOT = '<footer><p>&copy; site</p><a href="/t">Terms</a><a href="/p">Privacy</a></footer></body></html>'
_SIDE = '<div><h3>More</h3><ul><li><a href="/x">Link one</a></li><li><a href="/y">Link two</a></li></ul></div>'
_PROSE = "<p>" + "A paragraph of plain prose goes on for a good many words before it ends. " * 3 + "</p>"
#: Lists, tables and wrappers as they stand inside a text: short items, short cells, no links.
_INNER = (
    "<section><h2>Part</h2><ul>" + "<li>Two words</li>" * 60 + "</ul><ol>" + "<li>One</li>" * 40 + "</ol></section><h3>Table</h3><table><caption>Rows</caption><thead><tr><th>Name</th><th>Value</th></tr></thead><tbody>"
    + "<tr><td>Word</td><td>2</td></tr>" * 60 + "</tbody></table>" + "<div><p>Two words</p></div>" * 40 + "<h4>Terms</h4><dl>" + "<dt>Word</dt><dd>Its meaning</dd>" * 30 + "</dl>"
    + "<figure><figcaption>Some caption</figcaption></figure><blockquote>Quoted words.</blockquote><p>A line of the text with <a href='/l'>a link</a> in it.</p><p>And <a href='/m'>one</a> more of them.</p><pre>code</pre><hr><h5>Last</h5><h6>Lines</h6><center>Word</center><address>Some street</address><details><summary>More</summary></details>" * 8
)
#: What stands around texts in marked elements, and marks that texts carry too.
_MARKED = "".join(f"<div class='{w}'>Some words of it.</div>" for w in sorted(MARKS))
_UNSURE = "".join(f"<div class='{w}'><p>Words of the text in a block of it, a good many of them in all.</p></div>" for w in UNSURE) * 6
_BOXES = "<header><p>The site</p><p>Its motto</p></header><aside><h3>Else</h3><p>Words beside the text.</p></aside><form><label>Search</label><button>Go</button><select><option>One</option></select></form><fieldset><legend>Pick</legend></fieldset><dialog>Agree to it</dialog><menu><li>Copy</li></menu>"
_ADDED = "<section><h3>2 Comments</h3><p>Some reader said this.</p><p>Another one said that.</p></section>"
#: Labelled pages: what stands before the main text, the main text, what stands after it.
LABELLED = [
    (f"<html><body>{_MENU}<div>Ad</div>", f"<article><h1>A title</h1>{_PROSE * 4}<p>Short.</p></article>", _FOOT),
    (f"<html><body>{_MENU}{_SIDE}", f"<main><h1>Some title here</h1><h2>Part</h2>{_PROSE * 6}<ul><li>An item that is a sentence of the text.</li></ul></main>", f"{_SIDE}{_FOOT}"),
    (f"<html><body><table><tr><td><a href='/'>Home</a></td><td><a href='/n'>News</a></td></tr></table>", f"<div><p>{'Old pages have text in plain rows. ' * 5}</p>{_PROSE}<blockquote>Quoted words.</blockquote></div>", f"<form><input><button>Go</button></form>{_FOOT}"),
    (f"<html><body>{_MENU}{_SIDE}", f"<article><h1>A title</h1>{_PROSE * 2}{_INNER}{_PROSE * 2}</article>", f"{_SIDE}{_FOOT}"),
    (f"<html><body>{_MENU}{_MARKED}{_BOXES}", f"<div class='content'><h1>A title</h1>{_PROSE * 4}{_UNSURE}{_PROSE}</div>", f"{_ADDED}{_MARKED}{_FOOT}"),
    (f"<html><body>{_BOXES}<div>Words beside the article.</div><div class='search-page'>", f"<article><header><h1>A headline of the text</h1><p>And what it is about, in a line.</p></header>{_PROSE * 4}<form><p>{'Words in a form around all. ' * 9}</p></form></article>", f"</div><div><p>Words below it.</p></div>{_FOOT}"),
    (f"<html><body><form>{_MENU}{_BOXES}", f"<main><header><h2>A headline</h2></header>{_PROSE * 3}</main>", f"{_ADDED}</form>{_FOOT}"),
]


def main_text(pages: DataFrame, labelled=None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    scores = Scores(labelled or LABELLED)
    out = map_text(pages.select("page_id", "url", "html"), lambda c: [pa.array([extract(x, scores) for x in c.to_pylist()], pa.string())], "text string", column="html")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
