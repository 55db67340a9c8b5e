"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, each with the path of its open tags. A block's vector holds the
hashed tags, classes and ids of that path, its hashed words and a few ratios. A bidirectional LSTM in numpy
reads the sequence of a page's blocks in both directions, so that every block is labelled in the context of the whole
document; blocks labelled as article are joined. Pages of a batch run side by side, grouped by length.

The network is trained here, on ``TRAIN_PAGES`` pages built from the rules in ``_page`` (invented words, varied
layouts, known labels), with a fixed seed; it never sees the pages that it labels. Workers get its weights.

Defined results: a null or empty page, or one without an article block, has the empty text and 0 characters. Tags may be
unclosed, a page may end anywhere, and stray ``<`` are text. Repeated rows stay repeated.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkspark.llm.store import source
from inkspark.llm.words import slices

PATH_BUCKETS, WORD_BUCKETS, RATIOS = 256, 64, 8
WIDTH = PATH_BUCKETS + WORD_BUCKETS + RATIOS
HIDDEN = 16
TRAIN_PAGES, TRAIN_LANES, EPOCHS, RATE, SEED = 600, 24, 6, 0.02, 11
LANES, LANE_BLOCKS = 128, 20_000

#: A comment, a declaration or a tag. A quote opens an attribute value only after its equals sign, and only if it is closed.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)",
    re.S,
)
#: Elements whose content is no text of the page. Without an end tag, those of the first line hide the rest, the others nothing.
_HIDDEN_TO_END = frozenset(("script", "style"))
_HIDDEN = _HIDDEN_TO_END | frozenset(("noscript", "template", "title", "textarea", "select", "svg", "iframe"))
_HIDDEN_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in _HIDDEN}
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ITEM_STOPS = frozenset(("ul", "ol", "table", "dl", "div", "article", "section", "blockquote"))
_P_STOPS = frozenset(("div", "article", "section", "table", "td", "li", "blockquote"))
_P_ENDERS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


@dataclass
class Block:
    """Text of one block, which path buckets its open tags have, how many names they are, and how much of it lies in links."""

    text: str
    path: np.ndarray
    depth: int
    linked: int


class _Open:
    """The open tags, the number of each, and the path buckets of their names: nothing is walked for a block or an end tag without a start."""

    def __init__(self):
        self.stack: list[tuple[str, list[int]]] = []
        self.count: dict[str, int] = defaultdict(int)
        self.buckets = np.zeros(PATH_BUCKETS, np.int32)
        self.depth = 0

    def push(self, tag: str, names: list[str]) -> None:
        own = [_path_bucket(n) for n in names]
        for b in own:
            self.buckets[b] += 1
        self.stack.append((tag, own))
        self.count[tag] += 1
        self.depth += len(own)

    def close(self, names: set[str], stop: frozenset[str] = frozenset()) -> None:
        """Closes the innermost tag of those names, and what is open inside it, unless a tag of ``stop`` is further in."""
        if not any(self.count[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                for tag, own in self.stack[i:]:
                    self.count[tag] -= 1
                    self.depth -= len(own)
                    for b in own:
                        self.buckets[b] -= 1
                del self.stack[i:]
                return
            if self.stack[i][0] in stop:
                return


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    open_, parts, endless = _Open(), [], set()
    linked, path, depth = 0, None, 0

    def flush() -> None:
        nonlocal linked, path, depth
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, path, depth, linked))
            parts.clear()
        linked, path = 0, None

    def add(raw: str) -> None:
        nonlocal linked, path, depth
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        bare = text.strip()
        if path is None and bare:
            path, depth = open_.buckets > 0, open_.depth
        if open_.count["a"]:
            linked += len(bare)

    at = 0
    while m := _MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _HIDDEN and not m["end"]:
            flush()
            end = None if tag in endless else _HIDDEN_END[tag].search(page, at)
            if end or tag in _HIDDEN_TO_END:
                at = end.end() if end else len(page)
                continue
            endless.add(tag)
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if m["end"]:
            open_.close({tag})
            continue
        if tag in _CLOSES:
            open_.close(_CLOSES[tag], _ITEM_STOPS)
        elif tag in _P_ENDERS:
            open_.close({"p"}, _P_STOPS)
        if tag not in _VOID:
            names = [tag]
            if m["attrs"]:
                for _, *values in _NAMED.findall(m["attrs"]):
                    names += [w for w in re.split(r"[^a-z]+", next((v for v in values if v), "").lower()) if w]
            open_.push(tag, names)
    add(page[at:])
    flush()
    return out


@lru_cache(100_000)
def _word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS


@lru_cache(20_000)
def _path_bucket(token: str) -> int:
    return zlib.crc32(b"/" + token.encode("utf-8", "surrogatepass")) % PATH_BUCKETS


def vectors(page: list[Block]) -> np.ndarray:
    """(blocks, WIDTH) inputs of one page."""
    x = np.zeros((len(page), WIDTH), np.float32)
    for i, b in enumerate(page):
        x[i, :PATH_BUCKETS] = b.path
        words = b.text.lower().split()
        share = 0.5 / np.sqrt(len(words))
        for w in words:
            x[i, PATH_BUCKETS + _word_bucket(w)] += share
        n = len(b.text)
        x[i, PATH_BUCKETS + WORD_BUCKETS :] = (
            np.log1p(len(words)) / 4,
            min(1.0, b.linked / n),
            sum(c in ".,;:!?" for c in b.text) / n * 10,
            b.text[-1] in ".!?…",
            i / len(page),
            len(page) / (len(page) + 20),
            b.depth / 10,
            1.0,
        )
    return x


@dataclass
class Network:
    """Weights of the two directions, one after the other in the first axis, and of the output."""

    w: np.ndarray  # 2 x WIDTH x 4H
    u: np.ndarray  # 2 x H x 4H
    b: np.ndarray  # 2 x 1 x 4H
    v: np.ndarray  # 2H + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(xw: np.ndarray, u: np.ndarray, keep: bool):
    """Both directions over (steps, 2, lanes, 4H) inputs: the states, and what back-propagation needs."""
    steps, _, lanes, _ = xw.shape
    h, c = np.zeros((2, lanes, HIDDEN), np.float32), np.zeros((2, lanes, HIDDEN), np.float32)
    hs, saved = np.empty((steps, 2, lanes, HIDDEN), np.float32), []
    for t in range(steps):
        z = xw[t] + h @ u
        gates, g = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        if keep:
            saved.append((gates, g, before, tc, h_before))
    return hs, saved


def _back(dh_all: np.ndarray, saved: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the inputs, of u)."""
    steps, _, lanes, _ = dh_all.shape
    dz_all, du = np.empty((steps, 2, lanes, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((2, lanes, HIDDEN), np.float32), np.zeros((2, lanes, HIDDEN), np.float32)
    ut = np.ascontiguousarray(u.transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        gates, g, before, tc, h_before = saved[t]
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[..., : 3 * HIDDEN] = np.concatenate([dc * g, dc * before, dh * tc], -1) * gates * (1 - gates)
        dz[..., 3 * HIDDEN :] = dc * i * (1 - g * g)
        du += h_before.transpose(0, 2, 1) @ dz
        dh, dc = dz @ ut, dc * f
    return dz_all, du


def _lanes(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Padded (2, steps, lanes, WIDTH) inputs, the second with each lane reversed, and the lengths."""
    lens = np.array([len(p) for p in pages])
    x = np.zeros((2, lens.max(), len(pages), WIDTH), np.float32)
    for k, p in enumerate(pages):
        x[0, : len(p), k] = p
        x[1, : len(p), k] = p[::-1]
    return x, lens


def _turned(hs: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each lane's first ``len`` steps in reverse."""
    out = np.zeros_like(hs)
    for k, n in enumerate(lens):
        out[:n, k] = hs[:n, k][::-1]
    return out


def _forward(net: Network, pages: list[np.ndarray], keep: bool = False):
    x, lens = _lanes(pages)
    _, steps, lanes, _ = x.shape
    xw = (x.reshape(2, steps * lanes, WIDTH) @ net.w + net.b).reshape(2, steps, lanes, 4 * HIDDEN).transpose(1, 0, 2, 3)
    hs, saved = _run(xw, net.u, keep)
    forth, back = hs[:, 0], _turned(hs[:, 1], lens)
    score = forth @ net.v[:HIDDEN] + back @ net.v[HIDDEN:-1] + net.v[-1]
    return score, (x, lens, forth, back, saved)


def label(net: Network, pages: list[np.ndarray]) -> list[np.ndarray]:
    """For each page, which of its blocks are article."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
    while order:
        n = max(1, min(LANES, LANE_BLOCKS // len(pages[order[-1]])))
        part, order = order[-n:], order[:-n]
        score, _ = _forward(net, [pages[i] for i in part])
        for k, i in enumerate(part):
            out[i] = score[: len(pages[i]), k] > 0
    return out


@lru_cache(1)
def _vocabulary() -> list[str]:
    """Invented words for training pages."""
    rng, parts = random.Random(SEED), "ka lo mi ne ru sa te vo xi zu ber tor lin gan pel".split()
    return ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(4000)]


def _page(rng: random.Random) -> tuple[str, list[str]]:
    """One training page and its article blocks: invented words in one of many layouts."""
    vocabulary = _vocabulary()
    pick = lambda *xs: rng.choice(xs)
    word = lambda: rng.choice(vocabulary)
    ends = ("", "", "", "", ",", "!!", "***")
    words = lambda a, b: [w + rng.choice(ends) for w in rng.choices(vocabulary, k=rng.randrange(a, b))]
    sentence = lambda a=3, b=18: (s := " ".join(words(a, b)))[:1].upper() + s[1:] + pick(".", ".", ".", "!", "")
    link = lambda: f'<a href="/{word()}">{" ".join(words(1, 4))}</a>'
    bag = lambda tag, names: f"<{tag}{pick('', '', f' id={word()}')} class=\"{pick(*names)}{pick('', '', ' ' + word())}\">"
    maybe = lambda p: rng.random() < p
    good: list[str] = []

    def kept(text: str) -> str:
        good.append(" ".join(text.split()))
        return text

    def paragraph() -> str:
        s = " ".join(sentence() for _ in range(pick(1, 1, 2, 3, 6, 20)))
        k = rng.random()
        if k < 0.05:  # junk lines are still article text
            s = " ".join([word()] * rng.randrange(5, 120))
        elif k < 0.1:
            s = pick(" | ", "!! ", "&&& ", "%%% ", "$$$ ").join(words(4, 60))
        elif k < 0.13:
            s = s.upper()
        elif k < 0.2:
            s = pick(word(), f"{word()} {word()}.", f"{word()} 555-0199 {word()}@{word()}.com")
        if maybe(0.15):
            a = kept(s)
            return f"<p><b>{a}<br><p>{kept(sentence())}</p>"
        if maybe(0.1):
            first, rest = s.split(" ", 1) if " " in s else (s, "x")
            kept(f"{first} {rest}")
            return f"<p>{first} <a href=/{word()}>{rest}</a></p>"
        return f"<p>{pick('', '<em>')}{kept(s)}{pick('</p>', '</p>', '')}"

    def furniture(tag: str, names: tuple[str, ...]) -> str:
        inner = {
            0: lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(2, 9))) + "</ul>",
            1: lambda: " | ".join(link() for _ in range(rng.randrange(2, 6))),
            2: lambda: f"<p>{sentence()}</p>" * rng.randrange(1, 3),
            3: lambda: sentence(),
            4: lambda: f"<h3>{sentence(1, 4)}</h3><p>{sentence()}</p>",
        }[rng.randrange(5)]()
        return (f"<{tag}>" if maybe(0.4) and tag not in ("div", "section") else bag(tag, names)) + inner + f"</{tag}>"

    top = lambda: pick(
        furniture("nav", ("nav", "menu", "navbar", "navigation")), furniture("header", ("header", "masthead", "top", "site")), furniture("div", ("menu", "nav", "navbar", "breadcrumb", "topbar")),
        furniture("div", ("cookie", "cookies", "notice", "consent", "banner", "popup", "alert", "newsletter", "subscribe")), furniture("div", ("ad", "ads", "advert", "advertisement", "sponsor", "promo")),
    )
    side = lambda: pick(
        furniture("aside", ("sidebar", "related", "widget")), furniture("div", ("sidebar", "side", "widget", "related", "recommended", "share", "social")), furniture("div", ("ad", "ads", "advert", "sponsored", "promo")),
        f"<form action=/{word()}><label>{sentence(1, 4)}</label><input name=q><button>{word()}</button></form>", furniture("section", ("related", "newsletter", "recommended")),
    )

    def comments() -> str:
        one = lambda: pick(f'<div class="comment"><b>{word()}</b> <p>{sentence()} {sentence()}</p></div>', f'<article class="comment"><p>{sentence()}</p></article>', f'<li class="comment">{sentence()}</li>', f"<p>{sentence()} {sentence()}</p>")
        tag = pick("div", "section", "ul", "ol")
        return f"<{tag} {pick('class', 'id')}={pick('comments', 'comments', 'discussion', 'replies', 'responses', 'disqus')}>" + pick("", f"<h3>{sentence(1, 3)}</h3>") + "".join(one() for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    body = [top() for _ in range(rng.randrange(0, 4))]
    if maybe(0.2):
        body.append(side())
    opening = pick("<article>", "<article>", "<article>", "<main>", bag("article", ("post", "article", "entry", "story")), bag("div", ("content", "article", "post", "entry", "story", "body", "text", "main")), bag("main", ("content", "main")), bag("section", ("content", "article", "post")))
    closing = f"</{re.match('<([a-z]+)', opening)[1]}>"
    inside = [f"<h{pick(1, 1, 2)}>{kept(sentence(2, 9))}</h1>"] if maybe(0.85) else []
    for _ in range(pick(1, 2, 4, 8, 12, 30)):
        k = rng.random()
        if k < 0.78:
            inside.append(paragraph())
        elif k < 0.84:
            inside.append(f"<h2>{kept(sentence(1, 6))}</h2>")
        elif k < 0.88:
            inside.append("<ul>" + "".join(f"<li>{kept(sentence())}</li>" for _ in range(rng.randrange(1, 5))) + "</ul>")
        elif k < 0.91:
            inside.append(f"<blockquote>{kept(sentence())}</blockquote>")
        elif k < 0.94:
            inside.append(f"<div>{kept(sentence())}</div>")
        else:
            inside.append(pick(side(), furniture("div", ("ad", "ads", "advert", "share", "social", "promo"))))
    if maybe(0.1):
        inside.append(comments())
    bare = maybe(0.06) and closing != "</article>"
    body += ["".join(inside) if bare else opening + "".join(inside) + closing]
    body += [side() for _ in range(rng.randrange(0, 3))]
    if maybe(0.3):
        body.append(comments())
    if maybe(0.85):
        body.append(furniture("footer", ("footer", "site", "bottom")) if maybe(0.7) else furniture("div", ("footer", "copyright", "bottom", "legal")))
    page = "".join(body)
    if maybe(0.3):
        page = f'<div class="{pick("page", "wrapper", "container", "site")}">{page}</div>'
    head = f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{}}</style></head><body>"
    return head + page + pick("</body></html>", ""), good


@lru_cache(1)
def trained() -> Network:
    """The network, trained on built pages with Adam; the same in every run."""
    rng, maker = np.random.default_rng(SEED), random.Random(SEED)
    data = []
    for _ in range(TRAIN_PAGES):
        page, good = _page(maker)
        found, left = blocks(page), list(good)
        y = np.zeros(len(found), np.float32)
        for i, b in enumerate(found):
            if b.text in left:
                left.remove(b.text)
                y[i] = 1
        if len(found):
            data.append((vectors(found), y))
    r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
    bias[..., HIDDEN : 2 * HIDDEN] = 1  # the forget gates
    net = Network(r(2, WIDTH, 4 * HIDDEN), r(2, HIDDEN, 4 * HIDDEN), bias, r(2 * HIDDEN + 1))
    params = [net.w, net.u, net.b, net.v]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    data.sort(key=lambda d: len(d[0]))  # pages of like length run side by side
    parts = [data[a : a + TRAIN_LANES] for a in range(0, len(data), TRAIN_LANES)]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(parts)):
            part = parts[k]
            score, (x, lens, forth, back, saved) = _forward(net, [p for p, _ in part], keep=True)
            y, mask = np.zeros_like(score), np.zeros_like(score)
            for j, (_, yj) in enumerate(part):
                y[: len(yj), j], mask[: len(yj), j] = yj, 1
            ds = (_sigmoid(score) - y) * mask / mask.sum()
            dv = np.r_[(forth * ds[..., None]).sum((0, 1)), (back * ds[..., None]).sum((0, 1)), ds.sum()]
            dh = np.stack([ds[..., None] * net.v[:HIDDEN], _turned(ds[..., None] * net.v[HIDDEN:-1], lens)], 1)
            dz, du = _back(dh, saved, net.u)
            flat = dz.transpose(1, 0, 2, 3).reshape(2, -1, 4 * HIDDEN)
            grads = [x.reshape(2, -1, WIDTH).transpose(0, 2, 1) @ flat, du, flat.sum(1, keepdims=True), dv]
            t += 1
            rate = RATE * (1 - t / (EPOCHS * len(parts) + 1)) + 1e-4
            for p, g, mi, vi in zip(params, grads, m, v):
                mi *= 0.9
                mi += 0.1 * g
                vi *= 0.99
                vi += 0.01 * g * g
                p -= rate * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.99**t)) + 1e-8)
    return net


def main_text(pages: list[str | None], net: Network) -> list[str]:
    """The article text of each page."""
    cut = [blocks(p) if p else [] for p in pages]
    return ["\n\n".join(b.text for b, good in zip(c, y) if good) for c, y in zip(cut, label(net, [vectors(c) for c in cut]))]


def _extracted(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html", 1 << 20):
            text = main_text(batch.column("html").to_pylist(), net)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    wanted = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    kinds = dict(wanted.dtypes)
    return wanted.mapInArrow(partial(_extracted, net=trained()), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op9_lstm_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract_text(source(spark, sf_dir, "pages"))
