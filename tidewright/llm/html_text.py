"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into blocks of text between block-level tags. A block is described by its word count and link density,
those of its neighbours, whether it is a paragraph or heading, whether its ancestors say that it belongs to an article,
and how much they say that it is page furniture. A name that only hints at furniture counts the less, the more of the
page's text it holds, and not at all on what holds the article or its heading. A tree grown from LABELLED, a table of
labelled blocks, keeps or drops a block; half of its rows come without what the tags say, so that it can do without.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from tidewright.llm.common import map_texts

#: Elements that end no block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
#: Elements whose content is no text of the page.
HIDDEN = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title", "head")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an opening tag of the same name (or of a block, for p) closes.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
FURNITURE = frozenset("nav header footer aside form menu button dialog figcaption".split())
ARTICLE = frozenset("article main".split())
#: Words of names that say furniture wherever they stand, and such as may stand on what holds the article as well.
_FURNITURE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|masthead|footer|foot|copyright|sidebar|widget|recommend\w*|cookies?|consent|popup|modal|newsletter|subscribe|signup|login|comments?|replies|reply|respond|discussion|disqus|pagination|pager|skip|toolbar)(?:$|[\s_-])", re.I)
_FURNITURE_HINT = re.compile(r"(?:^|[\s_-])(?:promo\w*|header|legal|side|related|share|social|notice|alert|form|search|tags?|meta|byline)(?:$|[\s_-])", re.I)
_ARTICLE_HINT = re.compile(r"(?:^|[\s_-])(?:article|post|story|entry|content|body|main|text)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in HIDDEN}
#: Elements whose content is no markup: without an end tag they reach to the end of the page, as browsers have it.
RAW = frozenset("script style iframe textarea title".split())

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "prose", "article", "furniture"]
#: A small labelled table of pages: words, links (share of words in links), prose (a paragraph or heading), article,
#: furniture (0 to 1), then 1 if the block belongs to the main text. Neighbours are the lines around; a blank line ends a page.
LABELLED = """
1 1 0 0 1 0
1 1 0 0 1 0
2 1 0 0 1 0
7 0 0 0 1 0
9 0 1 1 0 1
31 0 1 1 0 1
84 0 1 1 0 1
2 0 1 1 0 1
47 0.04 1 1 0 1
14 0.1 0 0 1 0

1 1 0 0 1 0
1 1 0 0 1 0
3 0 0 0 1 0
1 0 1 1 0 1
1 0 1 1 0 1
8 0 0 0 1 0

1 1 0 0 1 0
16 0 0 0 1 0
12 0 1 1 0 1
4 0 1 1 0 1
140 0 1 1 0 1
6 0 1 1 0 1
21 0 0 0 1 0

3 1 0 0 0 0
1 1 0 0 0 0
1 1 0 0 0 0
2 1 0 0 0 0
4 0.75 0 0 0 0
7 0 1 0 0 1
3 0.3 0 0 0.7 0
52 0 1 0 0 1
90 0.03 1 0 0 1
24 0.1 1 0 0 1
66 0 1 0 0 1
2 0 0 0 0 0
6 1 0 0 0 0
8 1 0 0 0 0
5 1 0 0 0 0
11 0.6 0 0 0 0

1 1 0 0 0 0
2 1 0 0 0 0
5 0 0 0 0 0
48 0 0 0 0 1
120 0.02 0 0 0 1
35 0 0 0 0 1
75 0 0 0 0 1
2 0 0 0 0 0
3 1 0 0 0 0
55 0 0 0 0 1
1 1 0 0 0 0
9 0.4 0 0 0 0

2 1 0 0 1 0
8 0 1 1 0.1 1
41 0 1 1 0.1 1
1 0 1 1 0.1 1
95 0.1 1 1 0.2 1
12 0 0 0 1 0

6 0 1 0 0.1 1
58 0 1 0 0.1 1
22 0 1 0 0.2 1
2 0 0 0 0.9 0
3 1 0 0 0.9 0

10 0 1 1 0 1
27 0 1 1 0 1
5 0 0 1 0 1
3 0 0 1 0 1
1 0 0 1 0 1
14 0 0 1 0 1
40 0.2 1 1 0 1
12 1 1 1 0 1
6 1 0 1 0 0
7 1 0 1 0 0
5 1 0 1 0 0

9 0 1 1 0 1
63 0 1 1 0 1
2 0 1 0 1 0
18 0 1 0 1 0
33 0 1 1 1 0
55 0 1 0 1 0
4 0 0 0 1 0
1 0 0 0 1 0

26 0.1 0 0 1 0
2 0 0 0 1 0
1 1 0 0 1 0
11 0 1 1 0 1
38 0 0 1 0 1
70 0 1 1 0 1
9 0 0 1 1 0
3 0 0 1 1 0
30 0.3 0 0 1 0
5 0 0 0 1 0

62 0.05 0 0 1 0
2 0 0 0 1 0
9 0 1 1 0 1
44 0 1 1 0 1
12 0 0 1 0 1
9 0 0 1 0 1
21 0 0 1 0 1
30 0.1 0 1 0 1
8 0 0 1 0 1
52 0.05 1 1 0 1
11 0.2 0 1 0 1
26 0 0 1 0 1
6 1 0 1 0 0
9 1 0 1 0 0
14 0.9 0 1 0 0
4 0.8 0 1 0 0
120 0 0 1 1 0
48 0 0 0 1 0

5 0 1 0 0 1
60 0 1 0 0 1
13 0 1 0 0 1
70 0.1 1 0 0 1
12 1 1 0 0 0
9 1 1 0 0 0
15 0.9 1 0 0 0
7 1 1 0 0 0

8 0 1 1 0 1
15 0 0 1 0 1
1 0 0 1 0 1
7 0 0 1 0 1
1 0 0 1 0 1
19 0 0 1 0 1
2 0 0 1 0 1
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The table's features and labels, with what the tags say, and again without it but for what only they can tell."""
    x, y = [], []
    edge = [0.0, 0.0]
    for page in LABELLED.strip().split("\n\n"):
        rows = [[float(v) for v in line.split()] for line in page.split("\n")]
        for k, (words, links, prose, article, furniture, label) in enumerate(rows):
            around = [*(rows[k - 1][:2] if k else edge), *(rows[k + 1][:2] if k + 1 < len(rows) else edge)]
            x.append([words, links, *around, prose, article, furniture])
            y.append(int(label))
            if label == 0 and not prose and (words < 20 or not furniture) or label == 1 and (prose or words >= 32):
                x.append([words, links, *around, prose, 0.0, 0.0])
                y.append(int(label))
    return np.array(x, float), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A decision tree by Gini impurity: (share of ones,) or (feature, threshold, tree below, tree above)."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return (float(y.mean()),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(t), left
    if best is None:
        return (float(y.mean()),)
    _, f, t, left = best
    return f, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def judge(tree: tuple, row: list[float]) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


class _Open:
    """An open element: what its tag and names say, and the running text inside it."""

    __slots__ = ("name", "article", "named", "hinted", "holds", "words")

    def __init__(self, name: str, article: bool, named: bool, hinted: bool):
        self.name, self.article, self.named, self.hinted = name, article, named, hinted
        self.holds = article and not hinted and name in ARTICLE  # the article or its heading lies inside
        self.words = 0


def blocks(html: str | None) -> list[tuple[str, list[float]]]:
    """The text blocks of a page in order: (text, its own features: words, links, prose, article, furniture)."""
    html = html or ""
    out: list[tuple[str, int, float, bool, list[_Open]]] = []
    open_tags: list[_Open] = []
    text: list[str] = []
    linked: list[str] = []
    in_link, at, prose, total = 0, 0, False, 0

    def close_block():
        nonlocal total
        found = _SPACE.sub(" ", unescape("".join(text))).strip()
        if found:
            n = found.count(" ") + 1
            links = len(_SPACE.sub(" ", unescape("".join(linked))).split())
            out.append((found, n, min(1.0, links / n), prose, list(open_tags)))
            plain = max(0, n - links)
            total += plain
            for t in open_tags:
                t.words += plain
        text.clear()
        linked.clear()

    def add(part: str):
        if part:
            text.append(part)
            if in_link:
                linked.append(part)

    while True:
        m = _TOKEN.search(html, at)
        add(html[at : m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in HIDDEN and not m[1]:
            if name != "head":  # its children hide themselves; some pages never close it
                end = _END[name].search(html, at)
                closed = m[3].rstrip().endswith("/") and (name not in RAW or end is None)
                if not closed and (end or name in RAW):
                    at = end.end() if end else len(html)
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            in_link = 0 if m[1] else 1
        if name in INLINE:
            if name == "a" and not m[1]:
                add(" ") if linked else None
            continue
        close_block()
        in_link = 0
        if m[1]:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k].name == name:
                    del open_tags[k:]
                    break
        elif name not in VOID and not m[3].endswith("/"):
            if open_tags and open_tags[-1].name in SELF_CLOSING and (open_tags[-1].name == name or open_tags[-1].name == "p"):
                open_tags.pop()
            names = " ".join("".join(x) for x in _NAMES.findall(m[3]))
            header = name == "header" and any(t.name == "article" for t in open_tags)
            if name in ARTICLE or name == "h1":
                for t in open_tags:
                    t.holds = True
            article = name in ARTICLE or bool(_ARTICLE_HINT.search(names))
            open_tags.append(_Open(name, article, name in FURNITURE and not header, False))
            own = open_tags[-1]
            if names and not own.named:
                own.named = bool(_FURNITURE_NAME.search(names)) and name not in ARTICLE
                own.hinted = bool(_FURNITURE_HINT.search(names))
        prose = any(t.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre") for t in open_tags[-2:])
    close_block()

    def furniture(tags: list[_Open]) -> float:
        most = 0.0
        for t in tags:
            if t.name in ("body", "html"):
                continue
            if t.named and not (t.holds and t.name not in FURNITURE):
                return 1.0
            if t.hinted and not t.holds:
                most = max(most, 1 - t.words / total if total else 1.0)
        return most

    return [(found, [n, links, float(p), float(any(t.article for t in tags)), furniture(tags)]) for found, n, links, p, tags in out]


def main_text(html: str | None, tree: tuple) -> str:
    """The kept blocks of a page, joined by one newline; empty for a page without main text."""
    found = blocks(html)
    size = [f[:2] for _, f in found]
    edge = [0.0, 0.0]
    kept = [t for k, (t, f) in enumerate(found) if judge(tree, [*f[:2], *(size[k - 1] if k else edge), *(size[k + 1] if k + 1 < len(found) else edge), *f[2:]]) >= 0.5]
    return "\n".join(kept)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """Columns ``keep`` with text and n_chars of each page; null or empty html gives an empty text. Repeated rows stay.

    An empty table gives no rows. A kept column named text or n_chars gives way to the operator's.
    """
    tree = grow(*labelled())

    def make():
        def run(texts):
            out = [main_text(t, tree) for t in texts]
            return {"text": out, "n_chars": [len(t) for t in out]}

        return run

    return map_texts(pages, keep, html_col, make, "text string, n_chars bigint")
