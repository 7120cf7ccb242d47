"""HTML extraction: a recurrent block labeller over the sequence of a page's text blocks.

A page becomes its leaf blocks in order. Each block is read as a tag-path vector (tags and
hashed class and id words of the open elements), a hashed-word vector and a few ratios; a
bidirectional LSTM runs over the whole page and labels every block as main text or not from
what stands before and after it. The network is trained here, on pages made by a generator
with a fixed seed that knows common layouts; no page of the data is used for training.

Edge cases: a null or empty html, and a page without main text, give an empty string; long
pages are read whole; broken markup (elements left open, stray end tags, an unclosed comment
or script, which ends the page) is read as browsers do for text; a null page_id or url and
repeated rows pass through; columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botledger.llm.common import lean

# ---------------------------------------------------------------- blocks

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe svg xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body button caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split()) | frozenset({"li", "dd", "dt"})
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol table article section div main aside nav body html".split())


_HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)


class Block:
    """Text of a leaf block: columns of its tag path (open elements with their class and id words), depth, characters in links."""

    __slots__ = ("path", "depth", "text", "linked")

    def __init__(self, path: frozenset[int], depth: int, text: str, linked: int):
        self.path, self.depth, self.text, self.linked = path, depth, text, linked


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks of visible text in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[int], bool]] = []  # tag, columns of the path so far, whether it is a link
    parts: list[str] = []
    linked, links, at, page = 0, 0, 0, page or ""
    held: tuple[frozenset[int], int] | None = None

    def close() -> None:
        nonlocal linked, held
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(*(held or (frozenset(), 0)), text, linked))
        parts.clear()
        linked, held = 0, None

    def say(piece: str) -> None:
        nonlocal linked, held
        if piece:
            if held is None and not piece.isspace():
                held = (stack[-1][1] if stack else frozenset(), len(stack))
            parts.append(piece)
            if links:
                linked += len(piece)

    def pop_to(index: int) -> None:
        nonlocal links
        links -= sum(link for _, _, link in stack[index:])
        del stack[index:]

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _BLOCK:
            close()
        if tag == "br":
            say(" ")
            continue
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag not in _BLOCK and stack[i][0] in _BLOCK:
                    break
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
        if tag in _SIBLINGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _SIBLINGS[tag]:
                    pop_to(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
        if tag not in _VOID:  # a slash before the end of a tag means nothing in HTML, and may belong to an unquoted value
            marks = tuple(w for a in _MARK.finditer(attributes) for w in re.findall(r"[a-z]+", (a[2] or a[3] or a[4] or "").lower()))
            link = tag == "a" and _HREF.search(attributes) is not None
            links += link
            stack.append((tag, (stack[-1][1] if stack else frozenset()) | _columns(tag, marks), link))
    close()
    return out


# ---------------------------------------------------------------- vectors

_TAGS = "html body header footer nav aside main article section div p h1 h2 h3 h4 ul ol li a b form table tr td th blockquote pre figure figcaption button label select option dl dt dd span details summary fieldset address".split()
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
MARKS, WORDS, RATIOS = 96, 48, 6
WIDTH = len(_TAGS) + 1 + MARKS + WORDS + RATIOS
HIDDEN = 20


@functools.lru_cache(1 << 14)
def _columns(tag: str, marks: tuple[str, ...]) -> frozenset[int]:
    return frozenset([_TAG_AT.get(tag, len(_TAGS)), *(len(_TAGS) + 1 + zlib.crc32(w.encode()) % MARKS for w in marks)])


@functools.lru_cache(1 << 16)
def _word_column(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % WORDS


def vectors(page: list[Block]) -> np.ndarray:
    n, base = len(page), len(_TAGS) + 1 + MARKS
    x, rows = np.zeros((n, WIDTH), np.float32), np.arange(n)
    x[np.repeat(rows, [len(b.path) for b in page]), list(itertools.chain.from_iterable(b.path for b in page))] = 1
    words = [b.text.split() for b in page]
    sizes, chars = np.array([len(w) for w in words]), np.array([len(b.text) for b in page])
    columns = np.fromiter(map(_word_column, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
    hashed = np.bincount(np.repeat(rows, sizes) * WORDS + columns, minlength=n * WORDS).reshape(n, WORDS).astype(np.float32)
    x[:, base:-RATIOS] = hashed / np.maximum(1, np.sqrt((hashed**2).sum(axis=1)))[:, None]
    ratios = (
        np.minimum(1, np.log1p(sizes) / 6), np.minimum(1, np.array([b.linked for b in page]) / np.maximum(1, chars)), (np.cumsum(chars) - chars) / max(1, int(chars.sum())),
        np.array([b.text[-1] in ".!?" for b in page]), rows / max(1, n), np.minimum(1, np.array([b.depth for b in page]) / 12),
    )
    x[:, -RATIOS:] = np.stack(ratios, axis=1)
    return x


# ---------------------------------------------------------------- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = {}
        for side in "fb":
            self.w[f"{side}x"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN))
            self.w[f"{side}h"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))
            self.w[f"{side}c"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.w["out"] = rng.normal(0, 0.1, 2 * HIDDEN)
        self.w["bias"] = np.zeros(1)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, learning: bool = False) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, c, tape = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), []
        out = np.zeros((n, steps, HIDDEN))
        inner = x @ self.w[f"{side}x"] + self.w[f"{side}c"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = inner[:, t] + h @ self.w[f"{side}h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            live = mask[:, t, None]
            was = (h, c)
            c = live * (f * c + i * g) + (1 - live) * c
            h = live * (o * np.tanh(c)) + (1 - live) * h
            out[:, t] = h
            if learning:
                tape.append((t, *was, i, f, o, g, c))
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(s, x, mask)[0] for s in "fb"], axis=2)
        return both @ self.w["out"] + self.w["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        runs = {s: self._run(s, x, mask, learning=True) for s in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        p = _sigmoid(both @ self.w["out"] + self.w["bias"])
        slope = (p - y) * mask / mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / mask.sum())
        grad = {"out": (both * slope[:, :, None]).sum(axis=(0, 1)), "bias": np.array([slope.sum()])}
        for k, side in enumerate("fb"):
            into = slope[:, :, None] * self.w["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            wh = np.zeros_like(self.w[f"{side}h"])
            for t, h0, c0, i, f, o, g, c in reversed(runs[side][1]):
                live = mask[:, t, None]
                dh = dh + into[:, t]
                tc = np.tanh(c)
                own_h = dh * live
                own_c = dc * live + own_h * o * (1 - tc**2)
                dz = np.concatenate([own_c * g * i * (1 - i), own_c * c0 * f * (1 - f), own_h * tc * o * (1 - o), own_c * i * (1 - g**2)], axis=1)
                dz_all[:, t] = dz
                wh += h0.T @ dz
                dh = dz @ self.w[f"{side}h"].T + dh * (1 - live)
                dc = own_c * f + dc * (1 - live)
            grad[f"{side}h"] = wh
            grad[f"{side}x"] = x.reshape(-1, WIDTH).T @ dz_all.reshape(-1, 4 * HIDDEN)
            grad[f"{side}c"] = dz_all.sum(axis=(0, 1))
        return loss, grad

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, whether each block is main text. Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            z, longest = at, 0
            while z < len(order) and (z == at or (z - at + 1) * len(pages[order[z]]) <= 20_000):
                longest = len(pages[order[z]])
                z += 1
            part = order[at:z]
            x, mask = _pad([vectors(pages[i]) for i in part], longest)
            for i, s in zip(part, self.scores(x, mask)):
                out[i] = s[: len(pages[i])] > 0
            at = z
        return out


def _pad(seqs: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((len(seqs), longest, WIDTH), np.float32), np.zeros((len(seqs), longest))
    for i, s in enumerate(seqs):
        x[i, : len(s)], mask[i, : len(s)] = s, 1
    return x, mask


# ---------------------------------------------------------------- training pages

_NOISE = {
    "nav": [("nav", ""), ("nav", "menu"), ("div", "nav menu"), ("ul", "menu"), ("div", "navigation"), ("div", "navbar top"), ("div", "breadcrumb")],
    "head": [("header", ""), ("div", "header"), ("header", "site header"), ("div", "masthead banner"), ("div", "topbar")],
    "foot": [("footer", ""), ("div", "footer"), ("footer", "site footer"), ("div", "copyright"), ("div", "bottom")],
    "side": [("aside", ""), ("div", "sidebar"), ("aside", "sidebar"), ("div", "widget"), ("section", "related"), ("div", "related posts"), ("div", "tags")],
    "ad": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("aside", "ad"), ("div", "sponsored"), ("div", "promo"), ("section", "promo banner")],
    "notice": [("div", "cookie"), ("div", "cookie notice"), ("div", "notice"), ("div", "consent banner"), ("div", "alert"), ("div", "popup"), ("dialog", ""), ("div", "disclaimer")],
    "form": [("form", ""), ("form", "subscribe"), ("div", "newsletter"), ("form", "search"), ("div", "login form"), ("div", "signup")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment list"), ("ol", "comments"), ("div", "discussion"), ("section", "responses")],
    "share": [("div", "share"), ("ul", "social share"), ("div", "social")],
}
_MAIN = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry content"), ("div", "article body"), ("section", "story"), ("div", "main"), ("div", "page text")]


def _training_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page, and for each of its blocks whether it is main text."""
    out, labels = [], []
    syllables = "th er an en in re on at es or ti ed nd he st ing tion ly ha be ver sch ung heit que ción os la ez mente eux ou le tre ai".split()
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def words(n: int) -> str:
        ws = ["".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(n)]
        return " ".join(ws).capitalize() + pick([".", ".", "", "!"])

    def leaf(tag: str, n: int, y: int) -> None:
        labels.append(y)
        style = rng.random()
        text = words(n)
        if style < 0.12:
            text = f"<b>{text}<br>" if style < 0.05 else f"<b>{text}</b>"
        elif style < 0.2:
            text = f'{text} <a href="/x">{words(1)}</a>'
        out.append(f"<{tag}>{text}" + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>"))

    def noise(kind: str) -> None:
        tag, mark = pick(_NOISE[kind])
        how = pick(["class", "class", "id"])
        out.append(f'<{tag} {how}="{mark.replace(" ", pick([" ", "-", "_"]))}">' if mark else f"<{tag}>")
        plain = rng.random()
        if kind in ("nav", "share") or (kind in ("head", "side", "foot") and plain < 0.4):
            listed = rng.random() < 0.8
            out.append("<ul>" if listed and tag != "ul" else "")
            for _ in range(int(rng.integers(1, 8))):
                labels.append(0)
                link = f'<a href="/x">{words(int(rng.integers(1, 4)))}</a>'
                out.append(f"<li>{link}</li>" if listed or tag == "ul" else f"<div>{link}</div>")
            out.append("</ul>" if listed and tag != "ul" else "")
        elif kind == "form":
            for _ in range(int(rng.integers(1, 4))):
                leaf(pick(["label", "p", "div"]), int(rng.integers(1, 12)), 0) if rng.random() < 0.6 else leaf("p", 5, 0)
            labels.append(0)
            out.append(f"<button>{words(1)}</button>")
        elif kind == "comments":
            for _ in range(int(rng.integers(1, 6))):
                if tag == "ol":
                    leaf("li", int(rng.integers(3, 60)), 0)
                else:
                    out.append(pick(['<div class="comment">', "<article>", "<div>"]))
                    opened = out[-1][1:].split(" ")[0].rstrip(">")
                    if rng.random() < 0.5:
                        leaf(pick(["h4", "h3", "b"]) if rng.random() < 0.5 else "p", 2, 0)
                    for _ in range(int(rng.integers(1, 3))):
                        leaf("p", int(rng.integers(3, 60)), 0)
                    out.append(f"</{opened}>")
        elif plain < 0.5:
            labels.append(0)
            out.append(words(int(rng.integers(1, 30))))
        else:
            if rng.random() < 0.3:
                leaf(pick(["h2", "h3", "h4"]), int(rng.integers(1, 5)), 0)
            for _ in range(int(rng.integers(1, 4))):
                leaf("p", int(rng.integers(1, 40)), 0)
        out.append(f"</{tag}>")

    out.append("<!DOCTYPE html><html><head><title>t</title><script>var a='<p>';</script></head><body>")
    wrap = rng.random() < 0.4
    out.append(f'<div class="{pick(["wrapper", "page", "container", "site", "layout"])}">' if wrap else "")
    for kind in ("notice", "head", "nav", "ad", "side", "form"):
        if rng.random() < {"nav": 0.8, "ad": 0.4}.get(kind, 0.3):
            noise(kind)
    tag, mark = pick(_MAIN) if rng.random() < 0.6 else ("article", "")
    outer = rng.random() < 0.3 and tag == "article"
    out.append("<main>" if outer else "")
    out.append(f'<{tag} {pick(["class", "id"])}="{mark.replace(" ", pick([" ", "-", "_"]))}">' if mark else f"<{tag}>")
    if rng.random() < 0.85:
        if rng.random() < 0.15:
            out.append("<header>")
            leaf("h1", int(rng.integers(1, 12)), 1)
            out.append("</header>")
        else:
            leaf("h1", int(rng.integers(1, 12)), 1)
    for _ in range(int(rng.choice([1, 2, 3, 5, 8, 14, 25]))):
        kind = rng.random()
        if kind < 0.72:
            leaf("p", int(rng.integers(1, 90)), 1)
        elif kind < 0.8:
            leaf(pick(["h2", "h3"]), int(rng.integers(1, 8)), 1)
        elif kind < 0.87:
            kind_of = pick(["ul", "ol"])
            out.append(f"<{kind_of}>")
            for _ in range(int(rng.integers(1, 5))):
                leaf("li", int(rng.integers(1, 20)), 1)
            out.append(f"</{kind_of}>")
        elif kind < 0.9:
            out.append("<blockquote>")
            leaf("p", int(rng.integers(2, 40)), 1)
            out.append("</blockquote>")
        elif kind < 0.92:
            leaf("pre", int(rng.integers(2, 20)), 1)
        elif kind < 0.94:
            out.append("<table><tr>")
            leaf("td", int(rng.integers(1, 6)), 1)
            leaf("td", int(rng.integers(1, 6)), 1)
            out.append("</tr></table>")
        else:
            noise(pick(["ad", "ad", "side", "share", "form", "notice"]))
    if rng.random() < 0.2:
        noise(pick(["share", "comments", "form"]))
    out.append(f"</{tag}>")
    out.append("</main>" if outer else "")
    for kind in ("share", "comments", "side", "form", "ad", "notice", "foot"):
        if rng.random() < {"foot": 0.8}.get(kind, 0.25):
            noise(kind)
    out.append("</div>" if wrap else "")
    return "".join(out), labels


@functools.lru_cache(1)
def trained(pages: int = 1200, rounds: int = 8, batch: int = 60, seed: int = 5) -> Labeller:
    """The network after training with Adam on generated pages; equal arguments give equal weights."""
    rng = np.random.default_rng(seed)
    made = []
    while len(made) < pages:
        text, labels = _training_page(rng)
        found = leaf_blocks(text)
        if len(found) == len(labels):
            made.append((vectors(found), np.array(labels, float)))
    net = Labeller()
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    for r in range(rounds):
        order = sorted(rng.permutation(pages).tolist(), key=lambda i: len(made[i][1]) // 12)
        for part in rng.permutation(np.array_split(np.array(order), pages // batch), axis=0) if pages % batch == 0 else np.array_split(np.array(order), pages // batch):
            longest = max(len(made[i][1]) for i in part)
            x, mask = _pad([made[i][0] for i in part], longest)
            y = np.zeros(mask.shape)
            for j, i in enumerate(part):
                y[j, : len(made[i][1])] = made[i][1]
            _, grad = net.gradients(x, mask, y)
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.02 * (1 - r / rounds * 0.8)
                net.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


# ---------------------------------------------------------------- on Spark


def main_text(pages: list[str | None], net: Labeller) -> list[str]:
    found = [leaf_blocks(p) for p in pages]
    return ["\n".join(b.text for b, y in zip(blocks, keep.tolist()) if y) for blocks, keep in zip(found, net.label(found))]


def extract(pages: DataFrame, group: int = 256) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages; ``group`` pages are labelled at a time."""
    shared = pages.sparkSession.sparkContext.broadcast(trained().w)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller()
        net.w = shared.value
        for b in batches:
            for at in range(0, b.num_rows, group):
                part = b.slice(at, group)
                texts = main_text(part.column("html").to_pylist(), net)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
