"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks. Each becomes a vector: the elements and names on its tag path, hashed; its words, hashed; and a few
measures of length, links, punctuation and place. A bidirectional LSTM in numpy reads the whole sequence both ways, so every block is
classified in the context of the whole document.

There are no labels, so the fit makes them: pages of a bounded sample are taken apart, and their paragraphs are built into pages of many layouts, in
which it is known what is article and what is menu, header, footer, sidebar, notice, advert, form or comment. Names on paths are
left out at random, so that neighbours and content must do where names say nothing. The sample's own pages join in, with labels by their element names.
"""

from __future__ import annotations

import html as html_lib
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import named, packed, unpacked, whole_text
from tabprobe.llm.html_blocks import Block, blocks

OWN = ["text", "n_chars", "n_blocks"]
PATH, WORDS, MEASURES, HIDDEN = 64, 24, 10, 20
SIZE = PATH + WORDS + MEASURES
#: Blocks, padding included, of a batch of pages in the fit.
BATCH_STEPS = 32 * 400
#: Element names, and parts of class and id names, that stand for what is no article text. Used for the sample's own pages only.
OUTSIDE = set("nav header footer aside form menu dialog button fieldset head".split())
NAMED = {
    "menu": "nav navigation menu navbar breadcrumb toc tabs pager pagination".split(),
    "header": "header masthead topbar top branding logo".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "sidebar": "sidebar side aside widget rail related recommended trending".split(),
    "notice": "notice cookie consent gdpr alert banner popup modal newsletter subscribe".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner".split(),
    "form": "form search login signup contact".split(),
    "comments": "comment comments commentlist discussion replies reply respond disqus feedback".split(),
}
MAIN_NAMES = "article content post entry story main text body".split()
BOILER_NAMES = {n for names in NAMED.values() for n in names}


def vector_slot(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


class Slots(dict):
    """Remembered hash slots; starts anew when it holds very many."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) > 500_000:
            self.clear()
        slot = self[name] = vector_slot(name, self.size)
        return slot


PATH_SLOTS, WORD_SLOTS = Slots(PATH), Slots(WORDS)


def page_vectors(page: list[Block], drop: float = 0.0, rng: random.Random | None = None) -> np.ndarray:
    x = np.zeros((len(page), SIZE), np.float32)
    gone = {n for b in page for n in b.path if n[0] == "." and rng is not None and rng.random() < drop}
    for i, b in enumerate(page):
        row = x[i]
        for name in b.path:
            if name not in gone:
                row[PATH_SLOTS[name]] = 1.0
        words = b.text.lower().split()
        counts = np.bincount([WORD_SLOTS[w] for w in words], minlength=WORDS) if words else np.zeros(WORDS)
        row[PATH : PATH + WORDS] = counts / max(1.0, float(np.sqrt((counts**2).sum())))
        n, text = len(b.text), b.text
        marks = text.count(".") + text.count(",") + text.count("!") + text.count("?")
        row[PATH + WORDS :] = (
            log1p(n) / 5, log1p(len(words)) / 4, b.linked / n, min(1.0, 10 * marks / n), text[-1] in ".!?\"”:;", text[0].isupper(), i / len(page),
            1 - i / len(page), log1p(len(b.path)) / 3, n / max(1, len(words)) / 10,
        )
    return x


@dataclass
class Lstm:
    """One direction: input, recurrent and bias weights of the four gates (in, forget, out, new)."""

    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator) -> Lstm:
        b = np.zeros(4 * HIDDEN, np.float32)
        b[HIDDEN : 2 * HIDDEN] = 1
        return Lstm(
            (rng.standard_normal((SIZE, 4 * HIDDEN)) / np.sqrt(SIZE)).astype(np.float32), (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32), b
        )

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of all steps of a batch (rows, steps, features)."""
        rows, steps, _ = x.shape
        pre = x @ self.wx + self.b
        h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        out, trace = np.empty((rows, steps, HIDDEN), np.float32), []
        for t in range(steps):
            g = pre[:, t] + h @ self.wh
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, n = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            before_h, before_c = h, c
            c = f * c + i * n
            th = np.tanh(c)
            h = o * th
            out[:, t] = h
            if keep:
                trace.append((before_h, before_c, i, f, o, n, th))
        return out, trace

    def backward(self, x: np.ndarray, trace: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gx, gh, gb = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.b)
        dh, dc = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0])
        for t in range(x.shape[1] - 1, -1, -1):
            before_h, before_c, i, f, o, n, th = trace[t]
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - th * th)
            g = np.concatenate((dc * n * i * (1 - i), dc * before_c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - n * n)), axis=1)
            gx += x[:, t].T @ g
            gh += before_h.T @ g
            gb += g.sum(axis=0)
            dh, dc = g @ self.wh.T, dc * f
        return gx, gh, gb


@dataclass
class Labeller:
    ahead: Lstm
    back: Lstm
    out: np.ndarray  # 2 * HIDDEN + 1

    @staticmethod
    def fresh(seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        return Labeller(Lstm.fresh(rng), Lstm.fresh(rng), np.zeros(2 * HIDDEN + 1, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.ahead.wx, self.ahead.wh, self.ahead.b, self.back.wx, self.back.wh, self.back.b, self.out]

    @staticmethod
    def flipped(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each row's steps in reverse, padding staying at the end."""
        t = np.arange(x.shape[1])[None, :]
        source = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
        return np.take_along_axis(x, source[:, :, None], axis=1)

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of being main text, for every block of every page."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # pages of like length, so that little is padding
            longest = max(16, 2 * len(pages[order[at]]))
            group = [i for i in order[at : at + 256] if len(pages[i]) <= longest]
            at += len(group)
            x, lengths = padded([pages[i] for i in group])
            states, _ = self.ahead.forward(x)
            other, _ = self.back.forward(self.flipped(x, lengths))
            both = np.concatenate((states, self.flipped(other, lengths)), axis=2)
            p = 1 / (1 + np.exp(-np.clip(both @ self.out[:-1] + self.out[-1], -30, 30)))
            for row, i in enumerate(group):
                out[i] = p[row, : lengths[row]]
        return out

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        states, trace = self.ahead.forward(x, True)
        turned = self.flipped(x, lengths)
        other, other_trace = self.back.forward(turned, True)
        both = np.concatenate((states, self.flipped(other, lengths)), axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.out[:-1] + self.out[-1], -30, 30)))
        real = np.arange(x.shape[1])[None, :] < lengths[:, None]
        wrong = np.where(real, p - y, 0).astype(np.float32) / max(1, int(real.sum()))
        g_out = np.append((both * wrong[:, :, None]).sum(axis=(0, 1)), wrong.sum()).astype(np.float32)
        d = wrong[:, :, None] * self.out[:-1]
        return [*self.ahead.backward(x, trace, d[:, :, :HIDDEN]), *self.back.backward(turned, other_trace, self.flipped(d[:, :, HIDDEN:], lengths)), g_out]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), lengths.max(), SIZE), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
    return x, lengths


def by_names(page: list[Block]) -> np.ndarray:
    """Labels by element and class names, for the sample's own pages."""
    central = any("article" in b.path or "main" in b.path for b in page)
    return np.array([
        not (OUTSIDE & set(b.path)) and not any(n[1:] in BOILER_NAMES for n in b.path if n[0] == ".") and (not central or "article" in b.path or "main" in b.path)
        for b in page
    ], np.float32)


def made_page(main: list[str], others: list[str], rng: random.Random) -> str:
    """A page of random layout around an article; what is article is marked."""
    esc = html_lib.escape
    others = others or ["more", "home"]

    def short(low: int, high: int) -> str:
        return esc(" ".join(rng.choice(others).split()[: rng.randint(low, high)]) or "more")

    def sentence() -> str:
        words = rng.choice(others).split()
        at = rng.randrange(max(1, len(words) - 5))
        return esc(" ".join(words[at : at + rng.randint(4, 40)]) or "more")

    def named_as(kind: str) -> str:
        name = rng.choice(NAMED[kind]) + rng.choice(["", "", "-box", "-wrapper", "_1", " block"])
        return rng.choice([f' class="{name}"', f' class="{name}"', f' id="{name}"'])

    def links(n: int) -> str:
        inner = "".join(f'<li><a href="#">{short(1, 3)}</a></li>' for _ in range(n))
        return rng.choice([f"<ul>{inner}</ul>", inner.replace("<li>", "<span>").replace("</li>", "</span> "), "".join(f'<div><a href="#">{short(1, 3)}</a></div>' for _ in range(n))])

    def piece(kind: str) -> str:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        tag = tag if tag and rng.random() < 0.6 else rng.choice(["div", "section", "div", "td"] if kind != "ad" else ["div", "div", "aside", "p"])
        attrs = named_as(kind) if tag in ("div", "section", "td", "p", "aside") or rng.random() < 0.4 else ""
        if kind == "menu":
            body = links(rng.randint(2, 9))
        elif kind == "header":
            body = rng.choice([f"<h2>{short(1, 4)}</h2>", f"<p>{short(2, 6)}</p>" + links(rng.randint(1, 4)), f"<h1>{short(1, 3)}</h1>"])
        elif kind == "footer":
            body = f"&copy; {short(1, 3)} &middot; {sentence()}" + (links(rng.randint(0, 4)) if rng.random() < 0.4 else "")
        elif kind == "sidebar":
            body = f"<h3>{short(1, 3)}</h3>" + rng.choice([links(rng.randint(2, 6)), "".join(f"<p>{sentence()}</p>" for _ in range(rng.randint(1, 3)))])
        elif kind == "form":
            body = f"<label>{short(1, 3)}</label><input name=q>" + rng.choice(["", f"<p>{sentence()}</p>"]) + f"<button>{short(1, 2)}</button>"
        elif kind == "comments":
            each = rng.choice(["li", "div", "article"])
            body = f"<h3>{short(1, 3)}</h3>" + "".join(
                f'<{each} class="{rng.choice(["comment", "reply", "comment-body"])}"><b>{short(1, 2)}</b> <p>{sentence()}</p></{each}>' for _ in range(rng.randint(1, 5)))
        else:
            body = rng.choice([sentence(), f"<p>{sentence()}</p>", f"<p>{sentence()}</p><a href='#'>{short(1, 2)}</a>"])
        return f"<{tag}{attrs}>{body}</{tag}>"

    container = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
    attrs = f' class="{rng.choice(MAIN_NAMES)}{rng.choice(["", "-body", "-content", " single"])}"' if container in ("div", "section") or rng.random() < 0.3 else ""
    parts = [f"<h1 data-main>{esc(main[0])}</h1>"] if main else []
    for text in main[1:]:
        tag = rng.choice(["p"] * 9 + ["h2", "li", "blockquote", "pre"])
        inner = esc(text)
        if rng.random() < 0.15:
            inner = rng.choice(["<b>{}</b>", "<em>{}</em>", "<b>{}<br>", '<a href="#">{}</a>']).format(inner)
        parts.append(f"<{tag} data-main>{inner}" + (f"</{tag}>" if rng.random() < 0.9 else ""))
        if rng.random() < 0.06:
            parts.append(piece(rng.choice(["ad", "ad", "notice", "sidebar", "form"])))
    if rng.random() < 0.25:
        parts.append(piece("comments"))
    if rng.random() < 0.15:
        parts.insert(0, piece("header"))
    core = f"<{container}{attrs}>{''.join(parts)}</{container}>"
    before = [piece(k) for k in ("menu", "header", "notice", "ad", "form") if rng.random() < 0.45]
    after = [piece(k) for k in ("comments", "sidebar", "ad", "notice", "form", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    if rng.random() < 0.3:
        core = f'<div class="{rng.choice(["page", "wrap", "container", "layout"])}">{core}{"".join(after)}</div>'
        after = []
    return f"<html><head><title>{short(2, 6)}</title></head><body>{''.join(before)}{core}{''.join(after)}</body></html>"


def case_batches(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Up to 32 pages in one step, fewer where they are long, so that a padded batch stays below BATCH_STEPS or is one page."""
    at = 0
    while at < len(lengths):
        end, longest = at, 0
        while end < len(lengths) and end - at < 32 and (end == at or max(longest, lengths[end]) * (end + 1 - at) <= BATCH_STEPS):
            longest = max(longest, lengths[end])
            end += 1
        yield at, end
        at = end


def fit_pages(htmls: list[str], *, layouts: int = 5, rounds: int = 10, seed: int = 5) -> Labeller:
    """Adam over pages built from the given ones, and over these themselves; all their blocks are cases."""
    rng = random.Random(seed)
    own = [p for p in map(blocks, htmls) if p]
    articles = [[b.text for b, y in zip(p, by_names(p)) if y] for p in own]
    texts = [t for a in articles for t in a]
    cases = [(page_vectors(p), by_names(p)) for p in own]
    for article in articles:
        for _ in range(layouts):
            main = article if rng.random() < 0.7 else rng.sample(article, len(article)) if article else []
            main = (main * rng.choice([1, 1, 1, 1, 4]))[: rng.choice([6, 30, 300])]
            page = blocks(made_page(main, texts, rng))
            if page:
                cases.append((page_vectors(page, rng.choice([0.0, 0.2, 0.6]), rng), np.array([b.marked for b in page], np.float32)))
    model = Labeller.fresh()
    if not cases:
        return model
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in model.arrays()]
    step = 0
    for turn in range(rounds):
        rng.shuffle(cases)
        for at, end in case_batches([len(c[1]) for c in cases]):
            some = cases[at:end]
            x, lengths = padded([c[0] for c in some])
            y = np.zeros(x.shape[:2], np.float32)
            for i, (_, label) in enumerate(some):
                y[i, : len(label)] = label
            step += 1
            rate = 0.01 * (1 - 0.9 * (turn + end / len(cases)) / rounds)
            for a, g, (m, v) in zip(model.arrays(), model.gradients(x, lengths, y), moments):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fit(pages: DataFrame, html_col: str = "html", *, sample_pages: int = 240, max_chars: int = 80_000) -> Labeller:
    """Fit on at most ``sample_pages`` pages, chosen by a hash of their content, of at most ``max_chars`` characters each.

    Repeated pages teach repeatedly; null and empty ones teach nothing, and without any page the labeller is untrained.
    """
    rows = pages.select(whole_text(named(html_col)).alias("html")).where((F.length("html") > 0) & (F.length("html") <= max_chars))
    sample = rows.orderBy(F.xxhash64("html"), "html").limit(sample_pages)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        htmls = sorted(h for b in batches for h in b["html"])
        yield pd.DataFrame({"arrays": [[a.tobytes() for a in fit_pages(htmls).arrays()]]})

    row = sample.repartition(1).mapInPandas(train, "arrays array<binary>").collect()
    model = Labeller.fresh()
    if row:
        for a, data in zip(model.arrays(), row[0]["arrays"]):
            a[...] = np.frombuffer(data, np.float32).reshape(a.shape)
    return model


def extract(df: DataFrame, model: Labeller, html_col: str = "html", *, carry: list[str] | None = None, threshold: float = 0.4) -> DataFrame:
    """Add ``text`` (main text: chosen blocks in page order, joined by a space), ``n_chars`` (code points) and ``n_blocks`` (chosen, of all); they replace
    input columns of the same name. Null or empty pages have an empty text, repeated rows stay, a probability equal to the threshold is chosen, and an empty table stays empty. Whole pages
    are read, however long. No shuffle.
    """
    carry = df.columns if carry is None else carry

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for htmls in series:
            out = []
            for at in range(0, len(htmls), 256):
                pages = [blocks(h) for h in htmls.iloc[at : at + 256]]
                for page, p in zip(pages, model.probabilities([page_vectors(b) for b in pages])):
                    chosen = [b.text for b, x in zip(page, p) if x >= threshold]
                    out.append((" ".join(chosen), {"chosen": len(chosen), "all": len(page)}))
            yield pd.DataFrame(out, columns=["text", "n_blocks"])

    found = F.pandas_udf(run, "text string, n_blocks struct<chosen:int,all:int>")
    rows = df.select(packed(df, carry).alias("row"), whole_text(named(html_col)).alias("html")).withColumn("found", found("html"))
    return rows.select(*unpacked("row", carry, OWN), F.col("found.text").alias("text"), F.length("found.text").cast("long").alias("n_chars"), F.col("found.n_blocks").alias("n_blocks"))
