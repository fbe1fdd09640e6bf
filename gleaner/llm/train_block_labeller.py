"""Training of the block labeller from generated pages: ``python -m gleaner.llm.train_block_labeller``.

Pages are generated with a layout drawn from many: semantic elements or divs
with telling class names, in varying order, with menus, headers, sidebars,
notices, adverts, forms, comments, related links and footers around and inside
the article.  Words are random, so labels are learned from structure, position
and typical boilerplate words.  Blocks of main text begin with a private-use
character, which is taken off before the vectors are made.
"""

from __future__ import annotations

import io
import random
import sys
from pathlib import Path

import numpy as np

from .block_labeller import HIDDEN, Labeller, pad, vectors
from .html_blocks import blocks

MARK = ""

_SYLLABLES = "the th en er on an re in at or es ti ha ou st nd ing ed ly tion ble wh sh ea nt to ción que os as ra do mente co bo ie ez ll rr ja ga ung ich sch ver ein ge heit keit be zu ä ü ö eau eux oi ai ou vi pa ment é è ç".split()
_MENU = "Home News About Contact Login Search Products Blog Archive Help Sports World Business Subscribe Menu Shop Careers".split()
_LEGAL = ["All rights reserved.", "Privacy Policy", "Terms of Use", "© 2024 Example Media", "Copyright notice", "Imprint", "&copy; example.com"]
_NOTICE = ["We use cookies to improve your experience.", "Accept all", "This site uses cookies.", "Please enable JavaScript.", "Sign up for our newsletter.", "Breaking:"]
_NAMES = {
    "menu": ["menu", "nav", "navbar", "main-menu", "topnav", "breadcrumbs", "site-nav", "navigation", "mega-menu"],
    "header": ["header", "site-header", "masthead", "top-bar", "branding", "page-header", "logo"],
    "side": ["sidebar", "widget", "aside", "related", "trending", "most-read", "rail", "recommended", "popular-posts"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "banner", "sponsored", "promo", "ad-box", "sponsor"],
    "notice": ["notice", "cookie-banner", "cookie-notice", "alert", "consent", "newsletter", "popup", "gdpr", "message"],
    "form": ["form", "search-form", "signup", "login-box", "subscribe", "contact-form"],
    "comments": ["comments", "comment-list", "discussion", "responses", "replies", "comment", "disqus"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon"],
    "main": ["content", "article", "post", "entry-content", "article-body", "story", "main-content", "post-content", "text", "story-body"],
}


class _Generator:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        style = self.r.random()
        out = [self.word() for _ in range(self.r.randint(low, high))]
        if style < 0.08:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.16:
            out = [w + self.r.choice(["###", "***", "%%%", "$$$", "&amp;&amp;"]) for w in out]
        elif style < 0.22:
            out = [w for w in out[:6] for _ in range(self.r.randint(1, 8))]
        elif style < 0.27:
            out = [x for w in out for x in (w, "|")]
        else:
            out = [w + ("," if self.r.random() < 0.08 else ". " if self.r.random() < 0.08 else "") for w in out]
        return " ".join(out)

    def prose(self, most: int = 120) -> str:
        n = self.r.choice([1, 3, 8, 20, 40, most])
        text = self.words(1, n)
        return text[:1].upper() + text[1:] + self.r.choice([".", ".", ".", "", "!"])

    def attributes(self, kind: str) -> str:
        name = self.r.choice(_NAMES[kind])
        style = self.r.random()
        if style < 0.65:
            return f' class="{name}"'
        if style < 0.8:
            return f' id="{name}"'
        return f' class="{self.r.choice(["wrap", "col-4", "block", "module", "box"])} {name}"'

    def wrap(self, kind: str, inner: str, tag: str, semantic: bool) -> str:
        """With the semantic tag, plain or named, or a div with a telling name."""
        if semantic and tag:
            return f"<{tag}{self.attributes(kind) if self.r.random() < 0.4 else ''}>{inner}</{tag}>"
        other = self.r.choice(["div", "div", "div", "section"])
        return f"<{other}{self.attributes(kind)}>{inner}</{other}>"

    def links(self, low: int, high: int) -> str:
        items = [self.r.choice(_MENU) if self.r.random() < 0.5 else self.words(1, 4) for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.8:
            return "<ul>" + "".join(f'<li><a href="/x">{i}</a></li>' for i in items) + "</ul>"
        return "".join(f'<a href="/x">{i}</a> ' for i in items)

    def part(self, kind: str, semantic: bool) -> str:
        r = self.r
        if kind == "menu":
            return self.wrap(kind, self.links(2, 9), "nav", semantic)
        if kind == "header":
            inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.prose(20)}</p>"])
            return self.wrap(kind, inner + (self.links(2, 6) if r.random() < 0.4 else ""), "header", semantic)
        if kind == "side":
            inner = f"<h3>{self.words(1, 4)}</h3>" + r.choice([self.links(2, 8), f"<p>{self.prose(40)}</p>", f"<p>{self.prose(30)}</p><p>{self.prose(30)}</p>"])
            return self.wrap(kind, inner, "aside", semantic)
        if kind == "ad":
            inner = r.choice([self.prose(40), f"<p>{self.prose(40)}</p>", f'<a href="/ad">{self.words(2, 8)}</a>', "Advertisement"])
            return self.wrap(kind, inner, "", semantic)
        if kind == "notice":
            inner = r.choice([r.choice(_NOTICE), self.prose(30)])
            return self.wrap(kind, r.choice([inner, f"<p>{inner}</p><button>OK</button>"]), "", semantic)
        if kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>" + r.choice(["", f"<p>{self.prose(12)}</p>", "<select><option>a</option><option>b</option></select>"])
            return f"<form{self.attributes(kind) if r.random() < 0.5 else ''}>{inner}</form>" if r.random() < 0.85 else self.wrap(kind, inner, "", semantic)
        if kind == "comments":
            each = [f"<{t}{self.attributes('comments') if r.random() < 0.6 else ''}>" + f"<p>{self.prose(60)}</p>" + r.choice(["", '<a href="#">Reply</a>', f"<span>{self.word()}</span>"]) + f"</{t}>" for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 6))]
            return self.wrap(kind, r.choice(["", "<h3>Comments</h3>", f"<h2>{r.randint(1, 90)} Comments</h2>"]) + "".join(each), "", semantic)
        inner = r.choice([r.choice(_LEGAL), f"{r.choice(_LEGAL)} &middot; {self.prose(20)}", f"&copy; www.{self.word()}.example.com &middot; {self.prose(20)}", f"<p>{self.prose(20)}</p>" + self.links(1, 5)])
        return self.wrap("footer", inner, "footer", semantic)

    def article(self, semantic: bool) -> str:
        r = self.r
        out = []
        if r.random() < 0.85:
            out.append(f"<h1>{MARK}{self.words(1, 12)}</h1>")
        n = r.choice([1, 1, 2, 4, 8, 15, 40])
        loose = r.random() < 0.4
        for k in range(n):
            kind = r.random()
            if loose:
                text = f"<p>{'<b>' if k == 0 or r.random() < 0.1 else ''}{MARK}{self.prose()}{'<br>' if r.random() < 0.3 else ''}{'' if r.random() < 0.3 else '</p>'}"
            elif kind < 0.8:
                text = f"<p>{MARK}{self.prose()}</p>"
            elif kind < 0.86:
                text = f"<h2>{MARK}{self.words(1, 8)}</h2>"
            elif kind < 0.9:
                text = "<ul>" + "".join(f"<li>{MARK}{self.prose(12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
            elif kind < 0.93:
                text = f"<blockquote>{MARK}{self.prose(30)}</blockquote>"
            elif kind < 0.96:
                text = f'<p>{MARK}{self.words(2, 10)} <a href="/y">{self.words(1, 5)}</a> {self.prose(20)}</p>'
            else:
                text = self.part(r.choice(["ad", "side", "form", "notice"]), semantic)
            out.append(text)
        inner = "".join(out)
        if semantic:
            inner = f"<article{self.attributes('main') if r.random() < 0.3 else ''}>{inner}</article>"
        else:
            inner = f"<div{self.attributes('main')}>{inner}</div>"
        if r.random() < 0.35:
            inner = f"<main>{inner}{self.part('comments', semantic) if r.random() < 0.3 else ''}</main>"
        return inner

    def page(self) -> str:
        r = self.r
        semantic = r.random() < 0.65
        some = lambda kinds, p: [self.part(k, semantic) for k in kinds if r.random() < p]
        before = some(["notice", "menu", "header", "menu", "ad", "form", "side"], 0.4)
        after = some(["ad", "comments", "side", "side", "form", "notice", "menu", "footer"], 0.35)
        if r.random() < 0.3:
            r.shuffle(before)
        inner = "".join([*before, self.article(semantic), *after])
        if r.random() < 0.3:
            inner = f'<div class="{r.choice(["page", "container", "wrapper", "site"])}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>{inner}</body></html>"


def examples(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of generated pages."""
    generator, out = _Generator(seed), []
    for _ in range(n):
        page = blocks(generator.page())
        y = np.array([MARK in b.text for b in page], np.float32)
        for b in page:
            b.text = b.text.replace(MARK, "") or "-"
        out.append((vectors(page), y))
    return out


def gradients(model: Labeller, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over blocks and its gradient."""
    w, steps, pages = model.w, *x.shape[:2]
    tapes: dict[str, list] = {"f": [], "b": []}
    hidden = {d: model.run(x, live, d, tapes[d]) for d in "fb"}
    z = hidden["f"] @ w["out"][:HIDDEN] + hidden["b"] @ w["out"][HIDDEN:] + w["bias"]
    p, n = 1 / (1 + np.exp(-z)), live.sum()
    loss = -(live * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n
    dz = (p - y) * live / n
    grad = {"out": np.concatenate([np.tensordot(dz, hidden[d], 2) for d in "fb"]), "bias": np.array([dz.sum()])}
    for k, d in enumerate("fb"):
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        dproject = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
        grad[f"h{d}"] = np.zeros_like(w[f"h{d}"])
        for t, h, c, i, f, o, g, tanh, m in reversed(tapes[d]):
            dh = dh + dz[t][:, None] * w["out"][None, k * HIDDEN : (k + 1) * HIDDEN]
            do, dnew = dh * m * tanh, dh * m * o * (1 - tanh**2) + dc * m
            a = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
            dproject[t] = a
            grad[f"h{d}"] += h.T @ a
            dh, dc = dh * (1 - m) + a @ w[f"h{d}"].T, dc * (1 - m) + dnew * f
        flat = dproject.reshape(steps * pages, -1)
        grad[f"x{d}"], grad[f"c{d}"] = x.reshape(steps * pages, -1).T @ flat, flat.sum(axis=0)
    return float(loss), grad


def train(n: int = 24000, epochs: int = 4, seed: int = 11, rate: float = 4e-3, say=print) -> Labeller:
    """Fit by Adam in batches of pages of similar length."""
    model, data, r = Labeller.start(), examples(n, seed), np.random.default_rng(seed)
    data.sort(key=lambda d: len(d[1]))
    batches = [data[i : i + 32] for i in range(0, n, 32)]
    mean = {k: np.zeros_like(v) for k, v in model.w.items()}
    square = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        losses = []
        for b in r.permutation(len(batches)):
            x, live = pad([d[0] for d in batches[b]])
            y = np.zeros(live.shape, np.float32)
            for j, (_, labels) in enumerate(batches[b]):
                y[: len(labels), j] = labels
            loss, grad = gradients(model, x, live, y)
            losses.append(loss)
            step += 1
            scale = min(1.0, 5.0 / (sum(float((g**2).sum()) for g in grad.values()) ** 0.5 + 1e-9))
            now = rate * (1 - step / (epochs * len(batches)) * 0.9)
            for k, g in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * scale * g
                square[k] = 0.999 * square[k] + 0.001 * (scale * g) ** 2
                model.w[k] = (model.w[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        say(f"epoch {epoch}: loss {np.mean(losses):.4f}")
    return model


def accuracy(model: Labeller, data: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """Share of blocks with the right label."""
    right = [(p >= 0.5) == (y > 0.5) for p, (_, y) in zip(model.label_pages([x for x, _ in data]), data, strict=True)]
    return float(np.concatenate(right).mean())


def main() -> None:
    model = train()
    print("held-out accuracy", accuracy(model, examples(1000, 99)))
    out = io.BytesIO()
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in model.w.items()})
    target = Path(sys.argv[1]) if len(sys.argv) > 1 else Path(__file__).with_name("block_labeller.npz")
    target.write_bytes(out.getvalue())


if __name__ == "__main__":
    main()
