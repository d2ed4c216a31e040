"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element. Text of menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
weighs nothing, nor does text inside links outside an article. The weights are summed over a
sliding window of ``WINDOW`` lines; where the sum rises over a threshold at a
line with text is a surge point, where it falls back to nothing is a dive
point, and the text between them is kept. Where the page marks its article
(``article``, ``main`` and the like), only lines inside it weigh, and any text
is a surge; on other pages the sum must reach ``SURGE`` characters.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import ship, small_batches

WINDOW = 3
SURGE = 80

_OPEN = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_VALUE = re.compile(r""">|=\s*(["'])""")
_NUMBER = re.compile(r"&#([xX]?)([0-9a-fA-F]{9,});?")
#: Elements whose content is no text; one that isn't closed takes the rest of the page.
_SILENT = {name: re.compile(rf"</{name}(?![A-Za-z0-9:-])", re.I) for name in
           "script style noscript template textarea svg iframe title select object annotation".split()}
_MARKS = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements within a line.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr input math semantics mrow mi mo mn ms mtext "
                    "msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mspace".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the main text.
_ASIDE_TAGS = frozenset("nav footer aside form button menu dialog fieldset datalist".split())
#: First or last parts of the class and role names, and whole ids, of what isn't the main text.
_ASIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promos promotion "
                         "cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidebars aside rail menu menus nav "
                         "navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer footers copyright "
                         "comment comments commentlist disqus respond reply replies share sharing social related recommended "
                         "newsletter subscribe subscription signup login search form widget widgets toolbar complementary "
                         "contentinfo skip".split())
_COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Names that say too little inside an article, and first parts of names that say enough there.
_VAGUE_NAMES = frozenset("header masthead form search rail skip alert login notice notices copyright".split())
_CLEAR_PARTS = frozenset("ad ads advert advertisement comment comments cookie newsletter share sharing sponsor sponsored".split())
_BODY_NAMES = frozenset(("articlebody", "article-body", "article-content", "post-content", "entry-content", "main",
                         "story-body", "main-content", "post-body"))
_OPEN_ENDED = frozenset(("p", "li", "dt", "dd", "option", "tr", "td", "th"))  # end where the next block starts


def _names(attrs: str) -> tuple[set[str], set[str], set[str]]:
    """The names of an element's class, role and itemprop, their first and last parts, and its ids."""
    if "=" not in attrs:
        return set(), set(), set()
    whole, ids = set(), set()
    for m in _MARKS.finditer(attrs):
        (ids if m[1].lower() == "id" else whole).update((m[2] or m[3] or m[4] or "").lower().split())
    parts = set()
    for name in whole:
        split = [x for x in re.split(r"[^a-z]+", name) if x]
        if split and split[0] not in ("has", "with", "no", "is", "not"):
            parts |= {split[0], split[-1]}
    return whole, parts, ids


def _aside(tag: str, whole: set[str], parts: set[str], ids: set[str], inside: bool) -> bool:
    """Whether a block's names say that it isn't main text; headings always are, and inside an article only clear names count."""
    if tag in _HEADINGS:
        return False
    if inside:
        return bool(whole & (_ASIDE_NAMES - _VAGUE_NAMES) or {re.split("[-_]", n)[0] for n in whole} & _CLEAR_PARTS)
    return bool(parts & _ASIDE_NAMES or tag != "section" and ids & _ASIDE_NAMES)


def tags(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before it, whether it ends an element, name, attributes) of every tag; the last name is empty.

    One pass whose position never goes back: a ``>`` inside a quoted value
    doesn't end its tag, however long the value is. Once a tag has no end
    outside quotes, quotes are no longer minded, so that one stray quote doesn't
    cost the rest of the page and no scan is repeated. A tag or declaration
    without any ``>`` behind it goes up to the next ``<``.
    """
    size, last, minded = len(page), page.rfind(">"), True
    last_quote = {q: page.rfind(q) for q in "\"'"}

    def end_of(at: int) -> int:
        nonlocal minded
        start = at
        while minded:
            m = _VALUE.search(page, at)
            if not m:
                minded = False
            elif not m[1]:
                return m.start()
            elif last_quote[m[1]] < m.end():
                return page.find(">", m.end())
            else:
                at = page.index(m[1], m.end()) + 1
        return page.find(">", start)

    at, begin, text = 0, 0, []
    while (at := page.find("<", at)) >= 0:
        m = _OPEN.match(page, at)
        if not m:
            at += 1
            continue
        text.append(page[begin:at])
        if m[0] == "<!--":
            stop = page.find("-->", at + 2)
            at = begin = size if stop < 0 else stop + 3
            continue
        stop = -1 if m.end() > last else end_of(m.end()) if m[2] else page.find(">", m.end())
        if stop < 0:
            stop = page.find("<", m.end())
            at = begin = size if stop < 0 else stop
            continue
        at = begin = stop + 1
        if not m[2]:
            continue
        name, attrs = m[2].lower(), page[m.end():stop]
        if name in _SILENT:
            if not m[1] and not attrs.endswith("/"):
                close = _SILENT[name].search(page, at)
                stop = page.find(">", close.end()) if close else -1
                at = begin = size if stop < 0 else stop + 1
            continue
        yield "".join(text), bool(m[1]), name, attrs
        text = []
    yield "".join(text) + page[begin:], False, "", ""


def _unescape(text: str) -> str:
    """Character references decoded; a number too long for a code point gives U+FFFD, however long it is."""
    def short(m: re.Match) -> str:
        digits = m[2].lstrip("0") if m[1] else re.match("[0-9]*", m[2])[0].lstrip("0")
        return m[0] if len(digits) < 9 and len(m[2]) < 1000 else f"&#{m[1]}{digits or 0};" if len(digits) < 9 else "\ufffd"
    return html.unescape(_NUMBER.sub(short, text))


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters outside links, number of the marked article or 0) of the blocks of a page that aren't boilerplate."""
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    plain = inside = links = articles = 0
    skip, depth, firm = "", 0, False      # the element being left out, how often it is open, whether an article ends it
    bodies: list[list] = []               # open article containers: [tag, nested opens]

    def close_line() -> None:
        nonlocal plain
        if text:
            line = " ".join(_unescape("".join(text)).split())
            if line:
                out.append((line, plain, articles if inside else 0))
            text.clear()
        plain = 0

    for piece, end, tag, attrs in tags(page):
        if piece and not skip:
            text.append(piece)
            if not links:
                plain += len(piece.strip())
        if not tag:
            break
        block = tag not in _INLINE
        if skip:
            if tag == skip:
                if not end and skip in _OPEN_ENDED:
                    skip = ""
                else:
                    depth += -1 if end else 1
                    if depth <= 0:
                        skip = ""
                        continue
            elif skip in _OPEN_ENDED and block and tag != "br":
                skip = ""
            elif not end and tag in ("article", "main") and not firm:
                skip = ""
            elif end and bodies and tag == bodies[-1][0]:
                skip = ""
            if skip:
                continue
        if block:
            close_line()
        if end:
            if tag == "a":
                links = 0
            if bodies and tag == bodies[-1][0]:
                bodies[-1][1] -= 1
                if bodies[-1][1] <= 0:
                    bodies.pop()
                    inside -= 1
            continue
        if tag in _VOID or attrs.endswith("/"):
            continue
        whole, parts, ids = _names(attrs)
        if tag in ("html", "body"):
            continue
        if tag in ("article", "main") and not (parts | ids) & _COMMENT_NAMES or (whole | ids) & _BODY_NAMES:
            bodies.append([tag, 1])
            articles += not inside
            inside += 1
            continue
        if tag in _ASIDE_TAGS or tag == "header" and not inside or block and _aside(tag, whole, parts, ids, bool(inside)):
            skip, depth, firm = tag, 1, bool((parts | ids) & _COMMENT_NAMES)
            close_line()
            continue
        if bodies and tag == bodies[-1][0]:
            bodies[-1][1] += 1
        if tag == "a":
            links = 1
    close_line()
    return out


def windows(weight: list[int]) -> list[int]:
    """The sum of the ``WINDOW`` weights from each place on."""
    return [sum(weight[i:i + WINDOW]) for i in range(len(weight))]


def _article_lines(rows: list[tuple[str, int, int]]) -> list[str]:
    """The lines of one marked part without its dives; all of them if every line is links."""
    sums = windows([plain for _, plain, _ in rows])
    empty = [total == 0 and i + WINDOW <= len(rows) for i, total in enumerate(sums)]
    if not any(empty):
        return [text for text, _, _ in rows]
    dived = [any(empty[max(0, i - WINDOW + 1):i + 1]) for i in range(len(rows))]
    return [text for (text, _, _), gone in zip(rows, dived) if not gone or all(dived)]


def main_text(page: str | None) -> str:
    """The main text of one whole page; empty if there is none."""
    rows = lines(page or "")
    parts: dict[int, list] = {}
    for row in rows:
        if row[2]:
            parts.setdefault(row[2], []).append(row)
    if parts:
        surge = {k: max(windows([plain for _, plain, _ in part])) > SURGE for k, part in parts.items()}
        return " ".join(t for k, part in parts.items() if surge[k] or not any(surge.values()) for t in _article_lines(part))
    weight = [plain for _, plain, _ in rows]
    sums = windows(weight)
    if not sums or max(sums) <= SURGE:
        return " ".join(t for (t, _, _), w in zip(rows, weight) if w)  # a page of a few words
    kept, on = [], False
    for i, total in enumerate(sums):
        if not on and weight[i] and total > SURGE:
            on = True
        elif on and not weight[i] and total <= SURGE:
            on = False
        if on and weight[i]:
            kept.append(rows[i][0])
    return " ".join(kept)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns of every page with text and n_chars (code points), which replace any such columns.

    Defined cases: null or empty html, and pages without main text, give an
    empty text; a page whose windows never reach ``SURGE`` is kept as a whole,
    but for its boilerplate; broken and unclosed markup is read as far as it
    goes, in time that grows with the page alone; repeated rows are each extracted.
    """
    names = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(*names, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_html")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in small_batches(batches):
            texts = [main_text(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return rows.mapInArrow(run, (schema + ", " if schema else "") + "text string, n_chars long")


ship(__name__)
