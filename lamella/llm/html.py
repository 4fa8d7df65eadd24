"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from html import escape, unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPENING = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object textarea select title canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these ends an open one of the listed elements.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCKS - {"button", "label", "option", "legend", "body", "html", "head"}


@dataclass
class Block:
    """A run of text: its innermost element, the features of all its ancestors, its linked characters."""

    text: str
    tag: str
    above: frozenset[str]
    linked: int


class _Tags:
    """Finds the tags of a page in order, reading each character a fixed number of times.

    A tag ends at the first ``>`` outside quotes. Where a quote stays open to the end of the
    page, it and all later ones are read as plain characters; without a ``>`` behind it, ``<`` is text.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def end_of(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``."""
        if not self.quotes:
            return self.page.find(">", at)
        place = at
        while hit := STOP.search(self.page, place):
            if hit.group() == ">":
                return hit.start()
            place = self.page.find(hit.group(), hit.end()) + 1
            if not place:
                break
        self.quotes = False
        return self.page.find(">", at)

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next tag; comments are named ``!``."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "!", False, ""
            if start > self.last:
                return None
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, "!", False, ""
            name = OPENING.match(page, start)
            if name:
                end = self.end_of(name.end())
                return start, end + 1, name.group(1).lower(), page[start + 1] == "/", page[name.end() : end]
            at = start + 1
        return None


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The page's runs of text between block-level tags, with their ancestors' features and linked characters.

    Of the ancestors' features only those in ``known`` are kept, if it is given: a field gives
    others no weight, and so the work per tag is bounded however deep the page is.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = at = 0
    in_link = False
    nothing: frozenset[str] = frozenset()

    def flush() -> None:
        nonlocal linked
        text = SPACES.sub(" ", "".join(parts)).strip()
        if text:
            tag, above = stack[-1] if stack else ("none", nothing)
            blocks.append(Block(text, tag, above, linked))
        parts.clear()
        linked = 0

    def close(name: str) -> None:
        while stack:
            top, _ = stack.pop()
            opened[top] -= 1
            if top == name:
                break

    tags = _Tags(page)
    while True:
        hit = tags.after(at)
        found = page[at : hit[0] if hit else len(page)]
        if found:
            found = unescape(found)
            parts.append(found)
            linked += len(found.strip()) if in_link else 0
        if not hit:
            break
        _, at, name, closing, attributes = hit
        if name == "!":
            continue
        if name in SILENT and not closing:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if name == "a":
            in_link = not closing
        if name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
            continue
        if name not in BLOCKS:
            continue
        flush()
        if closing:
            if opened[name]:
                close(name)
            continue
        if name in ENDS_P:
            while opened["p"]:
                close("p")
        for other in CLOSES.get(name, ()):
            if stack and stack[-1][0] == other:
                close(other)
        if name not in VOID:
            values = " ".join(filter(None, (v for m in ATTRIBUTE.findall(attributes) for v in m))).lower()
            own = {f"in:{name}", *(f"named:{v}" for v in NAME.findall(values))}
            above = stack[-1][1] if stack else nothing
            own = (own if known is None else own & known) - above
            stack.append((name, above | own if own else above))
            opened[name] += 1
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Ancestor-tag and text features of each block."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        size = len(b.text)
        words = b.text.count(" ") + 1
        found = {f"tag:{b.tag}", f"size:{min(int(math.log2(size + 1)), 9)}", f"words:{min(words, 12) if words < 12 else 12 + min(words // 20, 4)}"}
        found.update(b.above)
        found.add(f"links:{min(4, 5 * b.linked // max(size, 1))}")
        found.add(f"signs:{min(5, 40 * sum(map(b.text.count, '.,;:!?')) // size)}")
        found.add(f"end:{'stop' if b.text[-1] in '.!?…' else 'other'}")
        found.add(f"place:{min(4, 5 * i // n)}")
        if "©" in b.text or "|" in b.text and words < 12:
            found.add("mark")
        out.append(sorted(found))
    return out


@dataclass(frozen=True)
class Crf:
    """Two labels, other (0) and main (1): weights of features for main, and of label pairs."""

    weights: dict[str, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]
    start: float

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.weights)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not rows:
            return []
        get, t = self.weights.get, self.pairs
        other, main, back = 0.0, self.start, []
        for i, row in enumerate(rows):
            u = sum(get(f, 0.0) for f in row)
            if i:
                from_other, from_main = other + t[0][0] >= main + t[1][0], other + t[0][1] >= main + t[1][1]
                back.append((not from_other, not from_main))
                other, main = max(other + t[0][0], main + t[1][0]), max(other + t[0][1], main + t[1][1])
            main += u
        label = int(main > other)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def _log_add(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log(math.exp(a - high) + math.exp(b - high))


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by stochastic gradients, with forward-backward sums and adaptive steps."""
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    t, t_seen = [[0.0, 0.0], [0.0, 0.0]], [[1.0, 1.0], [1.0, 1.0]]
    start, start_seen = 0.0, 1.0
    order = random.Random(7)
    for _ in range(rounds):
        for rows, labels in order.sample(pages, len(pages)):
            n = len(rows)
            if not n:
                continue
            u = [sum(w.get(f, 0.0) for f in row) for row in rows]
            ahead = [(0.0, u[0] + start)]
            for i in range(1, n):
                a, b = ahead[-1]
                ahead.append((_log_add(a + t[0][0], b + t[1][0]), _log_add(a + t[0][1], b + t[1][1]) + u[i]))
            behind = [(0.0, 0.0)] * n
            for i in range(n - 2, -1, -1):
                a, b = behind[i + 1][0], behind[i + 1][1] + u[i + 1]
                behind[i] = (_log_add(t[0][0] + a, t[0][1] + b), _log_add(t[1][0] + a, t[1][1] + b))
            z = _log_add(*ahead[-1])
            for i, row in enumerate(rows):
                gap = labels[i] - math.exp(ahead[i][1] + behind[i][1] - z)
                if i == 0:
                    start_seen += gap * gap
                    start += rate * gap / math.sqrt(start_seen)
                if abs(gap) < 1e-4:
                    continue
                for f in row:
                    g = gap - decay * w.get(f, 0.0)
                    seen[f] = seen.get(f, 1.0) + g * g
                    w[f] = w.get(f, 0.0) + rate * g / math.sqrt(seen[f])
            for i in range(1, n):
                for x in (0, 1):
                    for y in (0, 1):
                        p = math.exp(ahead[i - 1][x] + t[x][y] + (u[i] if y else 0.0) + behind[i][y] - z)
                        g = (labels[i - 1] == x and labels[i] == y) - p
                        t_seen[x][y] += g * g
                        t[x][y] += 0.3 * rate * g / math.sqrt(t_seen[x][y])
    return Crf(w, (tuple(t[0]), tuple(t[1])), start)


MARK = ""


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """An invented page and its blocks' labels; texts of the article carry a private mark.

    The layouts vary in what holds the article (article, main, named div or section, table cell,
    bare body), in the boilerplate around it, and in tags left open.
    """
    r = random.Random(seed)
    parts = ["ba", "ko", "rin", "tel", "é", "mun", "sa", "der", "ción", "ü", "lo", "th", "ing", "er", "va", "ñe"]

    def word() -> str:
        return "".join(r.choice(parts) for _ in range(r.randint(1, 4)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi)))

    def prose(lo: int, hi: int) -> str:
        out = []
        for _ in range(r.randint(lo, hi)):
            noisy = r.random() < 0.1
            out.append((words(3, 18) + r.choice([".", ".", "!", "?", ", " + words(2, 8) + ".", ""])).capitalize().replace(" ", "%% " if noisy else " "))
        return escape(" ".join(out), quote=False)

    def links(lo: int, hi: int) -> str:
        items = "".join(f'<li><a href="/{word()}">{word().capitalize()}</a></li>' for _ in range(r.randint(lo, hi)))
        return f"<ul>{items}</ul>"

    def named(*names: str) -> str:
        return f'{r.choice(["class", "class", "id"])}="{r.choice(names)}"'

    top = [
        lambda: f"<nav>{links(2, 9)}</nav>",
        lambda: f"<header><h1>{words(1, 3)}</h1><p>{words(2, 8)}</p></header>",
        lambda: f"<div {named('nav', 'menu', 'navbar', 'topmenu')}>{links(2, 8)}</div>",
        lambda: f"<div {named('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>{prose(1, 3)}</div>",
        lambda: f"<div {named('cookie', 'cookie-notice', 'notice', 'consent')}><p>{prose(1, 3)}</p><button>{word()}</button></div>",
        lambda: f"<div {named('breadcrumb', 'crumbs')}><a href='/'>{word()}</a> &gt; {word()}</div>",
        lambda: f"<form><label>{words(1, 2)}</label><input name=q><button>{word()}</button></form>",
    ]
    side = [
        lambda: f"<aside><h3>{words(1, 3)}</h3>{links(3, 8)}</aside>",
        lambda: f"<div {named('sidebar', 'widget', 'related')}><h4>{words(1, 3)}</h4><p>{prose(1, 2)}</p>{links(2, 5)}</div>",
        lambda: f"<div {named('ad', 'ads', 'advertisement', 'promo')}>{prose(1, 3)}</div>",
        lambda: f"<form {named('newsletter', 'subscribe', 'login')}><p>{prose(1, 2)}</p><label>{word()}</label><input></form>",
    ]
    comments = [
        lambda: f"<div {named('comments', 'comment-list', 'discussion')}><h3>{words(1, 2)}</h3>" + "".join(f"<div class='comment'><b>{word()}</b><p>{prose(1, 4)}</p></div>" for _ in range(r.randint(1, 4))) + "</div>",
        lambda: f"<section {named('comments', 'replies')}>" + "".join(f"<p>{prose(1, 3)}</p>" for _ in range(r.randint(1, 4))) + "</section>",
    ]
    bottom = [
        lambda: f"<footer>&copy; {word()}.example &middot; {prose(1, 2)}</footer>",
        lambda: f"<footer><p>&copy; {r.randint(1990, 2030)} {words(1, 4)}</p>{links(1, 5)}</footer>",
        lambda: f"<div {named('footer', 'copyright', 'bottom')}>{words(2, 6)} | {words(1, 3)}</div>",
    ]
    body = []
    if r.random() < 0.85:
        body.append(f"<h1>{MARK}{words(2, 9)}</h1>")
    for _ in range(r.randint(1, 12)):
        kind, text = r.random(), prose(1, 9) if r.random() < 0.8 else words(1, 4).capitalize() + "."
        if kind < 0.72:
            body.append(f"<p>{MARK}{text}</p>" if r.random() < 0.8 else f"<p><b>{MARK}{text}<br>")
        elif kind < 0.8:
            body.append(f"<h2>{MARK}{words(1, 6)}</h2>")
        elif kind < 0.88:
            body.append("<ul>" + "".join(f"<li>{MARK}{words(2, 12)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
        elif kind < 0.94:
            body.append(f"<blockquote>{MARK}{text}</blockquote>")
        else:
            body.append(f'<p>{MARK}{text} <a href="/{word()}">{words(1, 3)}</a> {words(2, 6)}.</p>')
        if r.random() < 0.04:
            body.append(r.choice(side)())
    inner = "".join(body)
    holder = r.choice(["article", "article", "article", "main", "div", "div", "section", "td", "bare"])
    held = {
        "article": f"<article>{inner}</article>",
        "main": f"<main>{inner}</main>",
        "div": f"<div {named('content', 'post', 'entry', 'story', 'article', 'text', 'main')}>{inner}</div>",
        "section": f"<section {named('content', 'story', 'article')}>{inner}</section>",
        "td": f"<table><tr><td>{links(2, 4)}</td><td>{inner}</td></tr></table>",
        "bare": inner,
    }[holder]
    page = [r.choice(top)() for _ in range(r.randint(0, 3))] + [held] + [r.choice(side)() for _ in range(r.randint(0, 2))]
    page += [r.choice(comments)()] * (r.random() < 0.35) + [r.choice(bottom)()] * (r.random() < 0.9)
    whole = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{''.join(page)}</body></html>"
    marked = leaf_blocks(whole)
    return whole.replace(MARK, ""), [int(MARK in b.text) for b in marked]


@lru_cache(4)
def trained(pages: int = 500, seed: int = 11) -> Crf:
    """The field trained on ``pages`` labelled pages; the bound of its sample."""
    sample = []
    for i in range(pages):
        page, labels = labelled_page(seed * 100_003 + i)
        rows = features(leaf_blocks(page))
        if len(rows) == len(labels):
            sample.append((rows, labels))
    return train(sample)


def main_text(page: str, model: Crf) -> str:
    blocks = leaf_blocks(page, model.known)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, model: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, from its whole html.

    Blocks are joined in page order by one line feed. Null or empty html, and pages without a
    main block, give an empty text. Malformed and very long pages are read in linear time. Repeated rows repeat their result; other columns are ignored;
    an empty table gives an empty result. Pages don't meet: there is no shuffle.
    """
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long"
    carried = pages.sparkSession.sparkContext.broadcast(model)  # some hundred weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                some = batch.iloc[a : a + 500]
                texts = [main_text(h, carried.value) if isinstance(h, str) else "" for h in some["html"]]
                yield pd.DataFrame({"page_id": some["page_id"], "url": some["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, schema)
