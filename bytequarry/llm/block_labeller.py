"""A bidirectional LSTM in numpy that labels each block of a page as main text or not.

A block's input is the mean vector of its hashed tag path, the mean vector of
its hashed words, and a few numbers. The network reads the page's blocks in
both directions, so each label sees the whole page. It is trained on pages that
this module makes up, whose labels are known as they are made.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np

from .html_blocks import Block, leaf_blocks

PATHS, WORDS = 1024, 2048
PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 16, 8, 6, 16
#: Weight of a path's mean, so that one telling name among many still shows.
PATH_SCALE = 3.0
#: Pages made for training, passes over them, pages a step.
PAGES, EPOCHS, BATCH = 3600, 9, 30
SEED = 20240601

_SPLIT = re.compile(r"[^a-z0-9]+")
_MARKS = ".,;:!?()"
_PUNCT = re.compile(r"[.,;:!?]")


@lru_cache(maxsize=50_000)
def _path_ids(path: tuple[tuple[str, str], ...]) -> np.ndarray:
    """Hashed names of the path: each element's tag, each with its nearest names (those with digits tell nothing by themselves), and the leaf's own again."""
    names = []
    for i, (tag, said) in enumerate(path):
        names.append(tag)
        names += [f".{x if x.isalpha() else '#'}" for x in _SPLIT.split(said) if x]
        if i + 2 >= len(path):
            names.append(f"{tag}@{len(path) - i}")
    return np.array([zlib.crc32(x.encode()) % PATHS for x in names] or [0])


def features(blocks: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    paths = [_path_ids(b.path) for b in blocks]
    words, numbers = [], np.zeros((len(blocks), NUMBERS))
    for i, b in enumerate(blocks):
        w = b.text.lower().split()
        words.append(np.array([zlib.crc32(x.strip(_MARKS).encode()) for x in w], np.int64) % WORDS)
        numbers[i] = (np.log1p(len(w)) / 4, min(1.0, b.linked / len(b.text)), min(1.0, 8 * len(_PUNCT.findall(b.text)) / len(b.text)), min(2.0, len(b.text) / len(w) / 8), i / len(blocks), np.log1p(len(blocks)) / 5)
    return paths, words, numbers


def _mean_rows(table: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    n = np.array([len(x) for x in ids])
    flat = table[np.concatenate(ids)]
    return np.add.reduceat(flat, np.cumsum(n) - n, axis=0) / n[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The weights; `params` maps a name to an array."""

    def __init__(self, params: dict[str, np.ndarray] | None = None) -> None:
        if params is None:
            rng = np.random.default_rng(SEED)
            size = PATH_DIM + WORD_DIM + NUMBERS
            params = {"path": rng.normal(0, 0.05, (PATHS, PATH_DIM)), "word": np.zeros((WORDS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * HIDDEN + size), "bias": np.zeros(1)}
            for d in "fb":
                params[f"x{d}"] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN))
                params[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
                params[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.params = params

    def _inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(steps, pages, size) inputs, padded at the end, and the mask of what is there."""
        steps = max(len(p[0]) for p in pages)
        x = np.zeros((steps, len(pages), PATH_DIM + WORD_DIM + NUMBERS))
        mask = np.zeros((steps, len(pages), 1))
        rows = np.concatenate([PATH_SCALE * _mean_rows(self.params["path"], [i for p in pages for i in p[0]]), _mean_rows(self.params["word"], [i for p in pages for i in p[1]]), np.concatenate([p[2] for p in pages])], axis=1)
        at = 0
        for k, p in enumerate(pages):
            n = len(p[0])
            x[:n, k], mask[:n, k] = rows[at : at + n], 1
            at += n
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """One direction's states; a padded step leaves the state as it is."""
        p, (steps, n, _) = self.params, x.shape
        h, c, out = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((steps, n, HIDDEN))
        z = x @ p[f"x{d}"] + p[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + h @ p[f"h{d}"]
            s = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            c2 = f * c + i * u
            tc = np.tanh(c2)
            h2 = o * tc
            if keep is not None:
                keep.append((t, i, f, o, u, c, tc, h))
            h, c = np.where(mask[t], h2, h), np.where(mask[t], c2, c)
            out[t] = h
        return out

    def scores(self, pages: list[tuple]) -> list[np.ndarray]:
        """The chance of being main text for each block of each page of features()."""
        x, mask = self._inputs(pages)
        y = np.concatenate([self._run(x, mask, "f", None), self._run(x, mask, "b", None), x], axis=2)
        p = _sigmoid(y @ self.params["out"] + self.params["bias"])
        return [p[: len(page[0]), k] for k, page in enumerate(pages)]

    def gradients(self, pages: list[tuple], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy and its gradients, by back-propagation through both directions."""
        p = self.params
        x, mask = self._inputs(pages)
        kept: dict[str, list] = {"f": [], "b": []}
        states = [self._run(x, mask, d, kept[d]) for d in "fb"]
        y = np.concatenate([*states, x], axis=2)
        want = np.zeros(mask.shape[:2])
        for k, l in enumerate(labels):
            want[: len(l), k] = l
        got = _sigmoid(y @ p["out"] + p["bias"])
        there = mask[:, :, 0]
        total = there.sum()
        loss = -(there * (want * np.log(got + 1e-12) + (1 - want) * np.log(1 - got + 1e-12))).sum() / total
        e = there * (got - want) / total
        grads = {"out": np.einsum("tn,tnk->k", e, y), "bias": np.array([e.sum()])}
        dy = e[:, :, None] * p["out"]
        dx = dy[:, :, 2 * HIDDEN :].copy()
        for d, part in (("f", dy[:, :, :HIDDEN]), ("b", dy[:, :, HIDDEN : 2 * HIDDEN])):
            dh, dc = np.zeros(part.shape[1:]), np.zeros(part.shape[1:])
            gx, gh, gc = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"]), np.zeros_like(p[f"c{d}"])
            for t, i, f, o, u, c, tc, h in reversed(kept[d]):
                m = mask[t]
                dh = dh + part[t]
                on = dh * m
                do, dtc = on * tc, on * o
                dcell = dc * m + dtc * (1 - tc * tc)
                g = np.concatenate([dcell * u * i * (1 - i), dcell * c * f * (1 - f), do * o * (1 - o), dcell * i * (1 - u * u)], axis=1)
                gx += x[t].T @ g
                gh += h.T @ g
                gc += g.sum(axis=0)
                dx[t] += g @ p[f"x{d}"].T
                dh = dh * (1 - m) + g @ p[f"h{d}"].T
                dc = dc * (1 - m) + dcell * f
            grads |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        for name, at, size, lists, scale in (("path", 0, PATH_DIM, 0, PATH_SCALE), ("word", PATH_DIM, WORD_DIM, 1, 1.0)):
            ids = [i for page in pages for i in page[lists]]
            n = np.array([len(i) for i in ids])
            rows = np.concatenate([dx[: len(page[lists]), k, at : at + size] for k, page in enumerate(pages)]) * (scale / n)[:, None]
            grads[name] = np.zeros_like(p[name])
            np.add.at(grads[name], np.concatenate(ids), np.repeat(rows, n, axis=0))
        return float(loss), grads


# --- pages with known labels ---------------------------------------------------

_SOUNDS = ["the", "an", "er", "on", "in", "re", "ti", "ou", "st", "ng", "le", "de", "ch", "ei", "en", "ge", "que", "ar", "os", "ci", "é", "ñ", "ü", "ing", "ha", "wh", "be", "tion", "ly"]
_SIDE = {
    "nav": (["nav", "ul", "div"], ["", "menu", "nav", "navbar", "topnav", "breadcrumb", "breadcrumbs", "links", "navigation", "site-nav", "pagination", "tabs", "toc"], "home news about contact login search next previous menu products services blog shop world sports politics business help faq sitemap archive events gallery start accueil inicio kontakt"),
    "header": (["header", "div"], ["", "header", "site-header", "masthead", "top", "logo", "branding", "page-header"], "welcome sign official site online daily news skip content"),
    "footer": (["footer", "div"], ["", "footer", "site-footer", "copyright", "legal", "bottom", "colophon"], "© copyright rights reserved privacy policy terms · powered inc ltd imprint contact sitemap"),
    "aside": (["aside", "div", "section"], ["", "sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "trending", "more-stories"], "related read more popular see recent posts latest stories categories archives tags"),
    "ad": (["div", "section", "aside"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "sponsor"], "sponsored buy offer advertisement free ad sale save click here"),
    "notice": (["div", "section"], ["notice", "cookie", "cookies", "cookie-notice", "consent", "gdpr", "alert", "banner", "newsletter", "subscribe", "popup", "modal", "paywall"], "cookies accept subscribe newsletter agree site continue"),
    "form": (["form", "div"], ["", "search", "login", "signup", "contact-form", "subscribe-form", "form"], "name email submit password search send log remember"),
    "comments": (["section", "div", "ol"], ["comments", "comment-list", "discussion", "replies", "responses", "disqus", "reader-comments", "user-comments"], "reply said posted ago comment comments leave anonymous"),
    "share": (["div", "ul", "p"], ["share", "social", "tags", "meta", "byline", "share-buttons", "post-meta", "author-bio"], "share tweet tags posted facebook email print"),
}
_MAIN = ["", "content", "main", "post", "entry", "article", "article-body", "post-content", "entry-content", "story", "body", "text", "main-content", "story-body", "page-content"]


class _Maker:
    """One page. `style` says what its class names tell: named, none, or hashed."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[tuple[str, int]] = []
        self.n = 0
        self.style = self.r.choices(["named", "none", "hashed"], [6, 2, 2])[0]

    def words(self, least: int, most: int, cues: list[str] | None = None) -> str:
        r = self.r
        mess = r.choice(["", "", "", "", "###", "|", "!!"]) if not cues else ""
        w = ["".join(r.choices(_SOUNDS, k=r.randint(1, 3))) + (mess if mess != "|" else "") for _ in range(r.randint(least, most))]
        if cues and r.random() < 0.6:
            w[r.randrange(len(w))] = r.choice(cues)
        if mess == "|":
            w = [x for y in w for x in (y, "|")][:-1]
        elif mess == "!!" and r.random() < 0.7:
            w = [x.upper() for x in w]
        text = " ".join(w)
        return text.capitalize() + r.choice([".", ".", "", "!", "?"]) if r.random() < 0.7 else text

    def said(self, kind: str, cues: list[str], most: int) -> str:
        """Text of a block beside the article: of its kind's own words where names tell nothing."""
        r = self.r
        if kind == "footer" and r.random() < 0.5:
            return f"{r.choice(['©', 'Copyright', 'Copyright ©', '(c)'])} {r.randint(1996, 2024)} {self.words(1, 3) if r.random() < 0.6 else ''} {r.choice(['', '', 'All rights reserved.', 'Privacy policy', 'Terms of use'])}"
        if r.random() < (0.35 if self.style == "named" else 0.8):
            w = r.sample(cues, r.randint(1, min(len(cues), 4 if most <= 6 else 9)))
            mark = r.choice([" | ", " · ", " » ", " / "]) if kind in ("nav", "footer", "share") and len(w) > 1 and r.random() < 0.5 else " "
            return mark.join(x.capitalize() if mark != " " else x for x in w).capitalize()
        return self.words(1, most, cues)

    def put(self, text: str, label: int) -> str:
        """A marked text, so that its block can be told again after parsing."""
        self.n += 1
        self.labels.append((f"q{self.n}z", label))
        return f"q{self.n}z {text}"

    def attr(self, name: str) -> str:
        r = self.r
        if self.style == "hashed" and r.random() < 0.7:
            name = f"{r.choice(['css', 'sc', 'x', 'jsx'])}-{r.randrange(1 << 32):x}"
        elif self.style == "none":
            name = ""
        return f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""

    def side(self, kind: str, bare: bool = False) -> str:
        """A part that is no article; bare: its items without a container."""
        r = self.r
        tags, names, cues = _SIDE[kind][0], _SIDE[kind][1], _SIDE[kind][2].split()
        name, tag = r.choice(names), r.choice(tags)
        if not name and tag not in ("nav", "header", "footer", "aside", "form"):
            name = r.choice([x for x in names if x])
        items = []
        for _ in range(r.randint(1, 8 if kind in ("nav", "comments", "aside") else 3)):
            long = kind in ("comments", "notice", "ad") and r.random() < 0.6 and (self.style == "named" or kind != "comments")
            text = self.put(self.said(kind, cues, 40 if long else 6), 0)
            if kind in ("nav", "aside", "share", "footer") and r.random() < 0.7:
                text = f'<a href="/{r.randrange(999)}">{text}</a>'
            if kind == "form":
                text = r.choice([f"<label>{text}</label>", f"<button>{text}</button>", f"<p>{text}</p>", f"<legend>{text}</legend>"]) + '<input name="q">'
            wrap = r.choice(["li", "p", "div", "span-div"] if kind != "comments" else ["div", "article", "p", "li"])
            inner = {"li": f"<li>{text}</li>", "p": f"<p>{text}</p>", "div": f"<div>{text}</div>", "article": f'<article class="comment"><p>{text}</p></article>', "span-div": f"<div><span>{text}</span></div>"}[wrap]
            items.append(inner)
        if bare or len(items) == 1 and r.random() < 0.6:
            body = re.sub(r"</?(li|p|div|span)>", "", items[0])
            return body if bare else f"<{tag}{self.attr(name)}>{body}</{tag}>"
        body = "".join(items)
        if kind == "nav" and r.random() < 0.6:
            body = f"<ul>{body}</ul>"
        return f"<{tag}{self.attr(name)}>{body}</{tag}>"

    def passage(self) -> str:
        """A paragraph of the article."""
        r = self.r
        text = self.put(self.words(1, r.choice([1, 2, 4, 12, 40, 80])), 1)
        x = r.random()
        if x < 0.12:
            text = f"<b>{text}<br>"
        elif x < 0.25:
            text = re.sub(r" (\w+) ", r' <a href="/x">\1</a> ', text, count=1)
        return text

    def main(self) -> str:
        r = self.r
        bits = []
        if r.random() < 0.85:
            bits.append(f"<{(h := r.choice(['h1', 'h1', 'h1', 'h2']))}>{self.put(self.words(1, 12), 1)}</{h}>")
        if r.random() < 0.25 and self.style == "named":
            bits.append(self.side("share"))
        plain = r.choices(["p", "div", "br"], [8, 1.5, 0.5])[0]
        for _ in range(r.choice([1, 1, 2, 3, 3, 5, 8, 12, 20])):
            text = self.passage()
            tag = r.choices([plain, "h2", "li", "blockquote", "div", "td", "pre", "ul", "dl", "table", "figcaption", "section"], [20, 2, 1, 1, 2, 0.5, 0.3, 2, 0.4, 0.5, 0.3, 0.4])[0]
            if tag in ("ul", "dl", "table"):
                more = [text, *(self.passage() for _ in range(r.randint(1, 7)))]
                if tag == "ul":
                    tag = r.choice(["ul", "ol"])
                    bits.append(f"<{tag}>{''.join(f'<li>{x}' + ('</li>' if r.random() < 0.9 else '') for x in more)}</{tag}>")
                elif tag == "dl":
                    bits.append(f"<dl>{''.join(f'<dt>{x}</dt>' if i % 2 == 0 else f'<dd>{x}</dd>' for i, x in enumerate(more))}</dl>")
                else:
                    bits.append(f"<table>{''.join(f'<tr><td>{x}</td></tr>' for x in more)}</table>")
            elif tag == "br":
                bits.append(f"{text}<br><br>{self.passage()}<p>{self.passage()}</p>" if r.random() < 0.5 else f"<p>{text}<br><br>{self.passage()}</p>")
            else:
                bits.append({"li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>", "figcaption": f"<figure><img src=x><figcaption>{text}</figcaption></figure>", "section": f"<section><p>{text}</p></section>"}.get(tag, f"<{tag}>{text}" + ("" if tag == "p" and r.random() < 0.2 else f"</{tag}>")))
            if r.random() < 0.06 and self.style == "named":
                bits.append(self.side(r.choice(["ad", "aside", "notice", "form"])))
        body = "".join(bits)
        shape = r.random()
        if shape < 0.42:
            body = f"<article{self.attr(r.choice(_MAIN)) if r.random() < 0.5 else ''}>{body}</article>"
            return f"<main>{body}</main>" if r.random() < 0.3 else body
        if shape < 0.55:
            return f"<main{self.attr(r.choice(_MAIN))}>{body}</main>"
        if shape < 0.7:
            return body
        body = f"<{(t := r.choice(['div', 'div', 'section']))}{self.attr(r.choice(_MAIN[1:]))}>{body}</{t}>"
        return f"<div{self.attr(r.choice(['', 'wrapper', 'container', 'page', 'row']))}>{body}</div>"

    def page(self) -> tuple[list[Block], np.ndarray]:
        r = self.r
        upper, lower = ["nav", "header", "ad", "notice", "nav", "share"], ["footer", "comments", "aside", "ad", "form", "nav", "share", "footer", "notice"]
        if self.style != "named":  # what no name tells must show by its words
            upper, lower = ["nav", "nav", "header", "notice"], ["footer", "aside", "form", "footer", "notice"]
        if r.random() < 0.08:  # a table lays the page out
            rows = [f"<tr><td colspan=2>{self.side(k, r.random() < 0.6)}</td></tr>" for k in r.sample(upper, r.randint(0, 2))]
            cells = [f"<td>{self.main()}</td>"]
            if r.random() < 0.6:
                cells.insert(r.randint(0, 1), f"<td>{self.side(r.choice(['nav', 'aside']))}</td>")
            low = [f"<tr><td colspan=2>{self.side('footer', r.random() < 0.6)}</td></tr>"] * (r.random() < 0.7)
            html = f"<table{r.choice(['', ' border=0', ' width=100%'])}>{''.join(rows)}<tr>{''.join(cells)}</tr>{''.join(low)}</table>"
        else:
            top = [self.side(k) for k in r.sample(upper, r.randint(0, 3))]
            body = self.main()
            low = [self.side(k) for k in r.sample(lower, r.randint(0, 4))]
            html = "".join(top) + body + "".join(low)
        blocks = leaf_blocks(f"<html><head><title>x</title></head><body>{html}</body></html>")
        known = dict(self.labels)
        kept, labels = [], []
        for b in blocks:
            marks = [known[x] for x in re.findall(r"q\d+z", b.text) if x in known]
            if marks:
                text = " ".join(re.sub(r"q\d+z", "", b.text).split())
                if text:
                    kept.append(Block(text, b.path, b.linked))
                    labels.append(max(marks))
        return kept, np.array(labels, float)


def made_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    made = (_Maker(seed * 1_000_003 + i).page() for i in range(n))
    return [x for x in made if x[0]]


@lru_cache(maxsize=1)
def trained() -> Labeller:
    """A labeller trained on PAGES made pages, the same each time (Adam, fixed seed)."""
    pages = [(features(b), l) for b, l in made_pages(PAGES, 1)]
    net, rng = Labeller(), np.random.default_rng(SEED)
    m = {k: np.zeros_like(v) for k, v in net.params.items()}
    v = {k: np.zeros_like(x) for k, x in net.params.items()}
    step, steps = 0, EPOCHS * -(-len(pages) // BATCH)
    for _ in range(EPOCHS):
        order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][1]) // 8)
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rng.shuffle(groups)
        for g in groups:
            step += 1
            _, grads = net.gradients([pages[i][0] for i in g], [pages[i][1] for i in g])
            norm = np.sqrt(sum((x * x).sum() for x in grads.values()))
            rate = 0.02 * (1 - 0.95 * step / steps)
            for k, x in grads.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                if k == "word":  # plain steps: Adam would move a word seen once as far as a telling one
                    net.params[k] -= rate * (50 * x + 1e-3 * net.params[k])
                    continue
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                net.params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net
