"""Main text of web pages: a recurrent labeller reads a page's blocks in order and keeps those of the article.

A page is cut into leaf sequences (runs of text between block-level tags). Each becomes a vector: the hashed tags and
class words of its path, hashed words of its text, and a few measures. A bidirectional LSTM in numpy reads the whole
sequence and classifies every block. It is trained here, on pages built from a seed: layouts with menus, headers,
footers, sidebars, notices, adverts, forms, related links and reader comments around articles, in made-up words, so
that what it learns is layout and not vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, text_blocks

#: Elements that end a block of text, elements without an end tag, elements whose content is no text.
BLOCK_TAGS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul title".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = set("script style noscript template textarea svg math iframe object canvas head".split())
#: Start tags that end an element whose end tag is left out, and what a head may hold.
CLOSED_BY = {"li": {"li"}, "p": BLOCK_TAGS - {"html", "body"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
HEAD_TAGS = set("base basefont bgsound link meta noframes noscript script style template title".split())
PATH_SLOTS, WORD_SLOTS, MEASURES = 96, 32, 8
WIDTH = 2 * PATH_SLOTS + WORD_SLOTS + MEASURES
_trained: dict[tuple, list[np.ndarray]] = {}


class Leaves(HTMLParser):
    """Blocks of a page: (words of its path, text, share of it in links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, tuple[str, ...]]] = []
        self.out: list[tuple[list[str], str, float]] = []
        self.text: list[str] = []
        self.linked = self.skip = 0
        self.in_link = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append(([x for tag, names in self.path for x in (tag, *names)], text, self.linked / max(1, sum(map(len, self.text)))))
        self.text, self.linked = [], 0

    def pop(self, k: int) -> None:
        for tag, _ in self.path[k:]:
            self.in_link -= tag == "a"
            self.skip -= tag in SKIPPED_TAGS
        del self.path[k:]

    def end_head(self, tag: str | None) -> None:
        """A head without an end tag ends at text, at body, and at elements that it can't hold."""
        k = max((i for i, (t, _) in enumerate(self.path) if t == "head"), default=-1)
        if k >= 0 and (tag == "body" or k == len(self.path) - 1 and tag not in HEAD_TAGS):
            self.pop(k)

    def handle_starttag(self, tag, attrs):
        self.end_head(tag)
        if tag in BLOCK_TAGS:
            if not self.skip:
                self.flush()
            while self.path and tag in CLOSED_BY.get(self.path[-1][0], ()):
                self.pop(len(self.path) - 1)
            if tag == "p":  # an open p ends here, with what was opened in it
                k = max((i for i, (t, _) in enumerate(self.path) if t == "p"), default=-1)
                if k >= 0 and not any(t in BLOCK_TAGS for t, _ in self.path[k + 1 :]):
                    self.pop(k)
        elif tag == "br" and not self.skip:
            self.text.append("\n")
        if tag in VOID_TAGS:
            return
        names = tuple(f"{k}={w}" for k, v in attrs if k in ("class", "id", "role") and v for w in re.findall(r"[a-z]+", v.lower()))
        hidden = any(k == "hidden" or k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs)
        self.path.append((tag, names + ("hidden",) * hidden))
        self.in_link += tag == "a"
        self.skip += tag in SKIPPED_TAGS

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS and not self.skip:
            self.flush()
        k = max((i for i, (t, _) in enumerate(self.path) if t == tag), default=-1)
        if k >= 0:
            self.pop(k)

    def handle_data(self, data):
        if self.skip and data.strip():
            self.end_head(None)
        if not self.skip:
            self.text.append(data)
            self.linked += len(data) * (self.in_link > 0)


def leaves(page: str) -> list[tuple[list[str], str, float]]:
    p = Leaves()
    try:
        p.feed(page)
        p.close()
    except (AssertionError, ValueError):  # a broken declaration: the rest is read without it
        p = Leaves()
        p.feed(re.sub(r"<!(?!--)[^>]*>?|<!\\[[^>]*>?", " ", page))
        p.close()
    p.flush()
    return p.out


def slot(word: str, many: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % many


_slots: dict[str, int] = {}


def vector(path: list[str], text: str, linked: float, at: float) -> np.ndarray:
    """The path's words twice (all of it; the three innermost), the text's words, and measures."""
    x = np.zeros(WIDTH, np.float32)
    for w in path:
        if w not in _slots and len(_slots) < 100_000:
            _slots[w] = slot(w, PATH_SLOTS)
        x[_slots.get(w) if w in _slots else slot(w, PATH_SLOTS)] = 1
    for w in path[-3:]:
        x[PATH_SLOTS + slot(w, PATH_SLOTS)] = 1
    words = text.split()
    if words:
        at_words = np.bincount([zlib.crc32(w) % WORD_SLOTS for w in text.lower().encode("utf-8", "surrogatepass").split()], minlength=WORD_SLOTS)
        x[2 * PATH_SLOTS : 2 * PATH_SLOTS + WORD_SLOTS] = at_words * min(0.25, 3 / len(words))
    n = len(text)
    stops = text.count(".") + text.count(",") + text.count("!") + text.count("?")
    x[-MEASURES:] = [np.log1p(n) / 6, np.log1p(len(words)) / 4, linked, min(1, 8 * stops / n), text[-1:] in ".!?", text[:1].isupper(), at, 1]
    return x


def vectors(blocks: list[tuple[list[str], str, float]]) -> np.ndarray:
    n = len(blocks)
    return np.stack([vector(*b, k / max(1, n - 1)) for k, b in enumerate(blocks)]) if n else np.zeros((0, WIDTH), np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray):
    """States of an LSTM over (pages, blocks, width); a masked block leaves the state as it is. Also what training needs."""
    n, steps, _ = x.shape
    size = u.shape[0]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    pre, out, kept = x @ w, np.empty((n, steps, size), np.float32), []
    for t in range(steps):
        z = pre[:, t] + h @ u
        i, f, o, g = sigmoid(z[:, :size]), sigmoid(z[:, size : 2 * size] + 1), sigmoid(z[:, 2 * size : 3 * size]), np.tanh(z[:, 3 * size :])
        m = mask[:, t, None]
        new = f * c + i * g
        th = np.tanh(new)
        kept.append((h, c, i, f, o, g, th, m))
        c = m * new + (1 - m) * c
        h = m * o * th + (1 - m) * h
        out[:, t] = h
    return out, kept


def lstm_back(x, u, kept, dout):
    n, steps, size = dout.shape
    dpre, du = np.empty((n, steps, 4 * size), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, th, m = kept[t]
        d = dh + dout[:, t]
        dn = dc * m + m * d * o * (1 - th**2)
        dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), m * d * th * o * (1 - o), dn * i * (1 - g**2)], 1)
        dpre[:, t] = dz
        du += h.T @ dz
        dh = dz @ u.T + (1 - m) * d
        dc = dn * f + (1 - m) * dc
    return np.einsum("nti,ntj->ij", x, dpre, optimize=True), du


def forward(params: list[np.ndarray], x: np.ndarray, mask: np.ndarray):
    w1, u1, w2, u2, v, _ = params
    a, k1 = lstm(x, mask, w1, u1)
    b, k2 = lstm(x[:, ::-1], mask[:, ::-1], w2, u2)
    both = np.concatenate([a, b[:, ::-1], x], 2)
    return both, sigmoid(both @ v), k1, k2


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(rows), max(map(len, rows)), WIDTH), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, 1
    return x, mask


def made_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page in one of many layouts, and for each of its blocks whether it is of the article."""
    vowels, others = "aeiouéäó", "bcdfghklmnprstvzñß"

    def word() -> str:
        return "".join(rng.choice(list(others)) + rng.choice(list(vowels)) for _ in range(rng.integers(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.integers(a, b)))

    def sentence() -> str:
        return words(1, 14).capitalize() + rng.choice([".", ".", ".", "!", "?", ".***", ""])

    def prose(most: int) -> str:
        return " ".join(sentence() for _ in range(rng.integers(1, most)))

    def pick(*x: str) -> str:
        return str(rng.choice(x))

    parts: list[str] = []
    truth: list[bool] = []

    def put(text: str, good: bool, before: str = "", after: str = "") -> None:
        parts.append(f"{before}{text}{after}")
        truth.append(good)

    def links(tag: str, attr: str) -> None:
        parts.append(f"<{tag}{attr}>")
        kind = rng.integers(3)
        if kind < 2:
            parts.append("<ul>")
            for _ in range(rng.integers(2, 9)):
                put(words(1, 4), False, '<li><a href="#">', "</a></li>" if kind else "</a>")
            parts.append("</ul>")
        else:
            put(" | ".join(f'<a href="#">{words(1, 3)}</a>' for _ in range(rng.integers(2, 7))), False, "<div>", "</div>")
        parts.append(f"</{tag}>")

    def bad(tag: str, attr: str, most: int = 4) -> None:
        inner = pick("", "p", "div", "span", "p", "h3+p")
        parts.append(f"<{tag}{attr}>")
        if inner == "h3+p":
            put(words(1, 5), False, "<h3>", "</h3>")
            inner = "p"
        for _ in range(rng.integers(1, 3) if inner in ("p", "div") else 1):
            put(prose(most), False, f"<{inner}>" if inner else "", f"</{inner}>" if inner else "")
        parts.append(f"</{tag}>")

    def named(*names: str) -> str:
        return f' {pick("class", "id")}="{pick("", "", "site-", "page-", "main-", "top-", "box ")}{pick(*names)}{pick("", "", "-1", "-wrap", " box")}"'

    def noise() -> None:
        k = rng.integers(9)
        if k == 0:
            bad("div", named("ad", "ads", "advert", "banner", "sponsored", "promo", "advertisement"))
        elif k == 1:
            links(pick("nav", "div"), named("menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "topnav", "links"))
        elif k == 2:
            bad(pick("aside", "div"), pick("", named("sidebar", "related", "widget", "aside")))
        elif k == 3:
            bad(pick("div", "section", "dialog"), named("cookie", "cookies", "consent", "notice", "gdpr", "popup", "newsletter", "subscribe", "modal"))
        elif k == 4:
            parts.append("<form>")
            put(words(1, 6), False, "<label>", "</label>")
            if rng.random() < 0.6:
                put(words(1, 3), False, "<p>", "</p>")
            put(words(1, 2), False, pick("<div>", "<fieldset>"), "<button></button></form>")
        elif k == 5:
            links(pick("aside", "div", "section"), named("related", "recommended", "share", "social", "tags", "sidebar", "more"))
        elif k == 6:
            links("nav", pick("", named("menu", "nav")))
        elif k == 7:
            bad("aside", pick("", named("ad", "sidebar", "related")))
        else:
            bad(pick("div", "p"), named("ad", "ads", "notice", "alert", "disclaimer", "cookie"), 3)

    def comments() -> None:
        parts.append(f"<{(tag := pick('section', 'div', 'div', 'ol'))}{named('comments', 'comment', 'responses', 'discussion', 'replies')}>")
        if rng.random() < 0.7:
            put(words(1, 3), False, "<h3>", "</h3>")
        for _ in range(rng.integers(1, 6)):
            parts.append(f"<{(inner := pick('div', 'article', 'li'))}{named('comment', 'reply', 'response')}>")
            if rng.random() < 0.5:
                put(words(1, 3), False, "<b>" if rng.random() < 0.3 else "<p>", "<br><p>" if rng.random() < 0.2 else "</p>")
            put(prose(5), False, "<p>", "</p>")
            parts.append(f"</{inner}>")
        parts.append(f"</{tag}>")

    body = f"{rng.choice(['<!DOCTYPE html>', ''])}<html><head><title>{words(2, 8)}</title><script>x</script></head><body>"
    parts.append(body)
    if rng.random() < 0.5:
        parts.append(pick("<header>", f"<div{named('header', 'masthead', 'top')}>"))
        closing = "</header>" if parts[-1] == "<header>" else "</div>"
        put(words(1, 6), False, pick("<h1>", "<div>", "<p>", "<h2>"), "</h1></div></p></h2>")
        if rng.random() < 0.5:
            links("nav", "")
        parts.append(closing)
    for _ in range(rng.integers(0, 4)):
        noise()
    wrap = pick("article", "article", "article", "article", "main", "main article", "div content", "div article", "div post", "section", "div", "")
    if wrap == "main article":
        parts.append("<main><article>")
        end = "</article></main>"
    elif wrap.startswith("div "):
        parts.append(f"<div{named(wrap[4:], wrap[4:] + '-body', 'entry', 'story', 'text')}>")
        end = "</div>"
    else:
        parts.append(f"<{wrap}>" if wrap else "")
        end = f"</{wrap}>" if wrap else ""
    if rng.random() < 0.9:
        if rng.random() < 0.2:
            parts.append("<header>")
            put(words(2, 10) + pick("", "."), True, "<h1>", "</h1></header>")
        else:
            put(words(1, 14).capitalize() + pick("", ".", "&amp;&amp;"), True, (h := pick("<h1>", "<h1>", "<h1>", "<h2>")), h.replace("<", "</"))
    for k in range(int(rng.integers(1, 14) if rng.random() < 0.85 else rng.integers(14, 60))):
        c = rng.random()
        if c < 0.08:
            put(words(1, 6), True, "<h2>", "</h2>")
        elif c < 0.14:
            parts.append(pick("<ul>", "<ol>"))
            for _ in range(rng.integers(2, 6)):
                put(words(1, 10), True, "<li>", "</li>")
            parts.append("</ul></ol>")
        elif c < 0.18:
            put(prose(4), True, "<blockquote>", "</blockquote>")
        elif c < 0.23:
            put(prose(3) + f' <a href="#">{words(1, 4)}</a> ' + prose(3), True, "<p>", "</p>")
        elif c < 0.28 and k:
            noise()
        elif c < 0.42:
            put(pick("", "", prose(6)) or word().capitalize() + ".", True, "<p><b>", "<br>")
        elif c < 0.48:
            put(pick(word().capitalize() + ".", words(1, 4)), True, "<p>", "</p>")
        elif c < 0.51:
            put(words(2, 8), True, "<table><tr><td>", "</td></tr></table>")
        else:
            put(prose(9), True, "<p>", pick("</p>", "</p>", "</p>", ""))
    inside = rng.random() < 0.15
    if inside:
        comments()
    parts.append(end)
    for _ in range(rng.integers(0, 3)):
        noise()
    if not inside and rng.random() < 0.45:
        comments()
    if rng.random() < 0.4:
        noise()
    if rng.random() < 0.8:
        parts.append((tag := pick("<footer>", "<footer>", f"<div{named('footer', 'bottom', 'copyright', 'legal')}>")))
        if rng.random() < 0.4:
            links("div", "")
        put(pick("&copy; ", "", "&copy; ") + words(1, 4) + pick(" &middot; ", " ", " ") + pick(prose(3), words(1, 5)), False, pick("", "", "<p>", "<div>"), "</footer>" if tag == "<footer>" else "</div>")
    return "".join(parts) + pick("</body></html>", "", "</body></html>"), truth


def train(seed: int = 5, pages: int = 900, hidden: int = 24, rounds: int = 12, rate: float = 0.01) -> list[np.ndarray]:
    """The labeller's parameters: fitted with Adam to the cross-entropy of all blocks of made-up pages."""
    key = (seed, pages, hidden, rounds, rate)
    if key in _trained:
        return _trained[key]
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < pages:
        page, truth = made_page(rng)
        found = leaves(page)
        if len(found) == len(truth):  # else two blocks have run together
            rows.append((vectors(found), np.array(truth, np.float32)))
    rows.sort(key=lambda r: len(r[1]))
    lots = [rows[i : i + 25] for i in range(0, pages, 25)]
    params = [rng.normal(0, 0.08, s).astype(np.float32) for s in ((WIDTH, 4 * hidden), (hidden, 4 * hidden), (WIDTH, 4 * hidden), (hidden, 4 * hidden), (2 * hidden + WIDTH, 1))] + [np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for turn in range(rounds):
        for k in rng.permutation(len(lots)):
            x, mask = padded([r[0] for r in lots[k]])
            y = padded([np.repeat(r[1][:, None], WIDTH, 1) for r in lots[k]])[0][:, :, :1]
            both, p, k1, k2 = forward(params, x, mask)
            d = ((p - y) * mask[:, :, None] / mask.sum()).astype(np.float32)
            dv = np.einsum("nti,ntj->ij", both, d, optimize=True) + 1e-4 * params[4]
            back = d @ params[4].T
            dw1, du1 = lstm_back(x, params[1], k1, back[:, :, :hidden])
            dw2, du2 = lstm_back(x[:, ::-1], params[3], k2, back[:, ::-1, hidden : 2 * hidden])
            step += 1
            for j, g in enumerate((dw1, du1, dw2, du2, dv)):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                params[j] -= rate * (0.3 if turn >= rounds - 3 else 1) * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    _trained[key] = params
    return params


def label(params: list[np.ndarray], pages: list[list[tuple[list[str], str, float]]]) -> list[np.ndarray]:
    """For each page the probability that a block is of the article."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    lot: list[int] = []
    for k in [*order, None]:
        if lot and (k is None or len(lot) * len(pages[k]) > 4000):
            rows = [vectors(pages[j]) for j in lot]
            x, mask = padded(rows)
            p = forward(params, x, mask)[1][:, :, 0]
            for j, r, q in zip(lot, rows, p, strict=True):
                out[j] = q[: len(r)]
            lot = []
        if k is not None:
            lot.append(k)
    return out


def extract(pages: DataFrame, params: list[np.ndarray] | None = None, threshold: float = 0.5) -> DataFrame:
    """Per page: page_id, url, text (blocks of the article, joined by one line end), n_chars, blocks.

    A null or empty html has empty text; so has a page without blocks. Character references are decoded and
    white space inside a block is one space. Rows are independent: repeated rows and null ids give a row each,
    an empty table none; other columns are ignored.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("blocks", pa.int32())])
    sent = pages.sparkSession.sparkContext.broadcast(params or train())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "html"):
            found = [leaves(x or "") for x in b.column("html").to_pylist()]
            text = ["\n".join(x[1] for x, p in zip(f, q, strict=True) if p >= threshold) for f, q in zip(found, label(sent.value, found), strict=True)]
            yield batch(schema, page_id=b.column("page_id"), url=b.column("url"), text=text, n_chars=[len(t) for t in text], blocks=[len(f) for f in found])

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, blocks int")
