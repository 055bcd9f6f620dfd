"""Trains the block labeller on generated pages: python -m windowflow.llm.train_html

Pages are made from templates that vary the containers, class words, nesting, order and sloppiness of
markup. Most of their words are random syllables, so that structure, lengths and a few ratios tell; the usual words
of menus, notices, adverts, forms and comments stand in half the blocks of such parts, and now and then in the article.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from .html import HIDDEN, INPUT, Block, blocks, encode

#: Class and id words of the parts of pages that are no main text.
JUNK = {
    "nav": "nav navbar menu navigation topnav main-menu breadcrumbs breadcrumb toolbar links pagination pager skip".split(),
    "header": "header masthead site-header banner topbar logo branding page-header".split(),
    "footer": "footer site-footer colophon bottom copyright legal page-footer".split(),
    "aside": "sidebar aside widget related recommended popular trending side rail more-stories tags".split(),
    "notice": "notice cookie cookie-notice cookies consent gdpr banner alert popup modal newsletter-notice message warning overlay".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion adsense banner-ad sponsor".split(),
    "form": "form subscribe newsletter signup login search contact subscription".split(),
    "comments": "comments comment-list comment discussion responses replies reader-comments disqus reply thread".split(),
    "share": "share social sharing follow buttons byline-links".split(),
}
GOOD = "article content post entry story main body text article-body post-content entry-content main-content page container wrapper".split()
#: Words that such parts use in many pages.
PHRASES = {
    "nav": "home about contact menu news archive next previous page search skip to content login",
    "header": "welcome home menu search login since official site",
    "footer": "copyright all rights reserved privacy policy terms of use imprint powered by contact",
    "aside": "related read more popular latest posts tags categories trending recommended also archive",
    "notice": "we use cookies to improve your experience accept this site uses agree learn more settings consent",
    "ad": "advertisement sponsored buy now sale offer limited discount promo shop order today free",
    "form": "subscribe newsletter email address sign up your name send submit enter search join",
    "comments": "comments reply leave a comment says replied ago report share thanks great post agree",
    "share": "share tweet follow us print email this like on pin it",
}
SYLLABLES = "an ba ci do er fu ga he in ja ko le mi no ou pa qui ra se ti un ve wa xi yo zu st nd th".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.part = ""

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        if self.part and r.random() < 0.5 or not self.part and r.random() < 0.02:
            usual = PHRASES[self.part or r.choice([*PHRASES])].split()
            at = r.randrange(len(usual))
            out = (usual * 2)[at : at + r.randint(lo, max(lo, min(hi, 12)))]
            return " ".join(out).capitalize() + r.choice(("", "."))
        out = ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) + ("," if r.random() < 0.08 else "." if r.random() < 0.1 else "") for _ in range(r.randint(lo, hi))]
        if r.random() < 0.05:
            out = [w + r.choice(("***", "&amp;&amp;&amp;", "%%%", "$$$", "###")) for w in out]
        return " ".join(out).capitalize() + r.choice(("", "."))

    def mark(self, text: str, good: bool) -> str:
        return ("\x01" if good else "\x02") + text

    def sentence(self, good: bool, lo: int = 3, hi: int = 60) -> str:
        r, t = self.r, self.words(lo, hi)
        if r.random() < 0.2:
            t += f" <{(tag := r.choice(('b', 'i', 'em', 'strong', 'a href=#', 'span')))}>{self.words(1, 4)}</{tag.split()[0]}> {self.words(1, 5)}"
        return self.mark(t, good)

    def paragraph(self, good: bool) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.1:
            return f"<p><b>{self.sentence(good, 1, 12)}<br>"
        if kind < 0.15:
            return "<p>" + self.sentence(good)
        if kind < 0.2:
            return f"<h{(n := r.randint(2, 4))}>{self.sentence(good, 1, 8)}</h{n}>"
        if kind < 0.25:
            return f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.sentence(good, 1, 12)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>"
        if kind < 0.28:
            return f"<blockquote><p>{self.sentence(good)}</p></blockquote>"
        if kind < 0.3:
            return f"<pre>{self.sentence(good)}</pre>"
        if kind < 0.32:
            return "<table>" + "".join(f"<tr><td>{self.sentence(good, 1, 4)}</td><td>{self.sentence(good, 1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.36:
            return f"<div>{self.sentence(good)}</div>"
        return f"<p>{self.sentence(good, *((1, 6) if r.random() < 0.25 else (5, 120)))}</p>"

    def junk(self, kind: str) -> str:
        around, self.part = self.part, kind
        out = self._junk(kind)
        self.part = around
        return out

    def _junk(self, kind: str) -> str:
        r = self.r
        name = r.choice(JUNK[kind])
        attr = r.choice((f'class="{name}"', f'id="{name}"', f'class="{name} {r.choice(("box", "wide", "dark", "left", "col", "block"))}"', f"class={name}"))
        plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = plain if plain and r.random() < 0.6 else r.choice(("div", "section", "div", "ul" if kind == "nav" else "div"))
        head = f"<{tag}>" if tag == plain and r.random() < 0.7 else f"<{tag} {attr}>"
        b = lambda lo=1, hi=8: self.sentence(False, lo, hi)
        n = r.randint(1, 8)
        if kind in ("nav", "share") or kind == "aside" and r.random() < 0.4:
            items = "".join(f'<li><a href="/{i}">{b(1, 3)}</a></li>' for i in range(n))
            inner = items if tag == "ul" else f"<ul>{items}</ul>" if r.random() < 0.7 else "".join(f"<a href=/{i}>{b(1, 2)}</a> " for i in range(n))
            if tag != "ul" and r.random() < 0.3:
                inner = f"<h3>{b(1, 3)}</h3>{inner}"
        elif kind == "form":
            inner = f"<label>{b(1, 3)}</label><input name=q><p>{b(2, 12)}</p><button>{b(1, 2)}</button>"
        elif kind == "comments":
            inner = f"<h{(k := r.randint(2, 4))}>{b(1, 3)}</h{k}>" * (r.random() < 0.6) + "".join(r.choice((f'<div class="comment"><p>{b(3, 60)}</p></div>', f"<li><b>x</b> {b(3, 40)}</li>", f"<p>{b(3, 60)}</p>", f"<div>{b(2, 40)}</div>", f"<article class=comment><p>{b(3, 50)}</p></article>")) for _ in range(r.randint(1, 5)))
        elif kind == "header":
            inner = r.choice((f"<h1>{b(1, 4)}</h1>", f"<a href=/>{b(1, 3)}</a>", f"<div>{b(1, 5)}</div><p>{b(2, 10)}</p>")) + (self.junk("nav") if r.random() < 0.4 else "")
        else:
            inner = b(3, 25) if r.random() < 0.5 else "".join(f"<p>{b(2, 30)}</p>" for _ in range(r.randint(1, 3)))
            if r.random() < 0.2:
                inner += f"<a href=x>{b(1, 3)}</a>"
        return f"{head}{inner}</{tag}>"

    def page(self) -> str:
        r = self.r
        body = [self.paragraph(True) for _ in range(r.randint(1, 25))]
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            body.insert(r.randint(0, len(body)), self.junk(r.choice(("ad", "share", "aside", "form", "notice", "nav"))))
        title = f"<h1>{self.sentence(True, 1, 12)}</h1>"
        if r.random() < 0.15:
            title = f"<header>{title}</header>"
        inner = (title if r.random() < 0.9 else "") + "".join(body)
        style = r.random()
        if style < 0.6:
            main = f"<article{r.choice(('', '', f' class={chr(34)}{r.choice(GOOD)}{chr(34)}'))}>{inner}</article>"
        elif style < 0.75:
            main = f"<main>{inner}</main>"
        else:
            main = f'<div {r.choice(("class", "id"))}="{r.choice(GOOD)}">{inner}</div>'
        if r.random() < 0.3:
            main = r.choice((f"<main>{main}", f'<div class="{r.choice(GOOD)}">{main}', f"<div>{main}", "<div id=main>" + main)) + (self.junk("comments") if r.random() < 0.3 else "") + r.choice(("</main>", "</div>", ""))
        before = [self.junk(k) for k in ("nav", "header", "notice", "ad", "aside", "form") if r.random() < 0.45]
        after = [self.junk(k) for k in ("comments", "aside", "ad", "form", "share", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.7:
            self.part = "footer"
            after.append(f"<footer>{self.sentence(False, 2, 14)}</footer>")
        end = r.choice(("</body></html>", ""))
        return "<!DOCTYPE html><html><head><title>x</title></head><body>" + r.choice(("", "<!-- ad -->")).join([*before, main, *after]) + end


def sample(seed: int) -> tuple[list[Block], np.ndarray]:
    found, y = [], []
    for b in blocks(Maker(seed).page()):
        marks = [c for c in b.text if c in "\x01\x02"]
        if marks:
            found.append(b._replace(text=b.text.replace("\x01", "").replace("\x02", "")))
            y.append(marks[0] == "\x01")
    return found, np.array(y, np.float32)


def train(pages: int = 6000, epochs: int = 8, size: int = 32, rate: float = 4e-3, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights by back-propagation through time and Adam."""
    rng = np.random.default_rng(seed)
    data = sorted(((encode(b), y) for b, y in map(sample, range(pages)) if len(b)), key=lambda d: len(d[1]))
    shape = {"wf": (INPUT, 4 * HIDDEN), "uf": (HIDDEN, 4 * HIDDEN), "bf": (4 * HIDDEN,), "v": (2 * HIDDEN,), "c": ()}
    shape |= {"wb": shape["wf"], "ub": shape["uf"], "bb": shape["bf"]}
    w = {k: (rng.normal(0, 0.15, s) if len(s) > 1 else np.zeros(s)).astype(np.float64) for k, s in shape.items()}
    w["v"] = rng.normal(0, 0.15, 2 * HIDDEN)
    m1, m2, step = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}, 0
    groups = [data[i : i + size] for i in range(0, len(data), size)]
    for epoch in range(epochs):
        total = 0.0
        for gi in rng.permutation(len(groups)):
            group = groups[gi]
            steps = max(len(y) for _, y in group)
            x, xb = np.zeros((len(group), steps, INPUT)), np.zeros((len(group), steps, INPUT))
            y, mask = np.zeros((len(group), steps)), np.zeros((len(group), steps))
            for k, (a, b) in enumerate(group):
                x[k, : len(b)], xb[k, : len(b)], y[k, : len(b)], mask[k, : len(b)] = a, a[::-1], b, 1
            flip = np.array([[len(b) - 1 - t if t < len(b) else t for t in range(steps)] for _, b in group])
            rows = np.arange(len(group))[:, None]
            drop = rng.random((len(group), steps, 1)) < 0.9
            h1, save1 = _forward(x * drop, w["wf"], w["uf"], w["bf"])
            h2, save2 = _forward(xb * drop[rows, flip], w["wb"], w["ub"], w["bb"])
            both = np.concatenate((h1, h2[rows, flip]), axis=2)
            p = 1 / (1 + np.exp(-np.clip(both @ w["v"] + w["c"], -30, 30)))
            total += float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / mask.sum())
            d = (p - y) * mask / mask.sum()
            g = {"v": (both * d[..., None]).sum((0, 1)), "c": d.sum()}
            dh = d[..., None] * w["v"]
            g["wf"], g["uf"], g["bf"] = _backward(dh[..., :HIDDEN], save1, w["uf"])
            g["wb"], g["ub"], g["bb"] = _backward(dh[..., HIDDEN:][rows, flip], save2, w["ub"])
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for k in w:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8) - now * 1e-4 * w[k]
        print(f"epoch {epoch}: loss {total / len(groups):.4f}", flush=True)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _forward(x, w, u, b):
    pages, steps, _ = x.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    z, hs, saved = x @ w + b, np.empty((pages, steps, HIDDEN)), []
    for t in range(steps):
        g = z[:, t] + h @ u
        s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
        a = np.tanh(g[:, 3 * HIDDEN :])
        c2 = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * a
        saved.append((s, a, c, np.tanh(c2), h))
        c, h = c2, s[:, 2 * HIDDEN :] * np.tanh(c2)
        hs[:, t] = h
    return hs, (x, saved)


def _backward(dh, save, u):
    x, saved = save
    pages, steps, _ = x.shape
    dz, gu = np.zeros((pages, steps, 4 * HIDDEN)), np.zeros_like(u)
    later, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    for t in range(steps - 1, -1, -1):
        s, a, c, tc, h = saved[t]
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        d = dh[:, t] + later
        dc = dc + d * o * (1 - tc**2)
        dz[:, t] = np.concatenate((dc * a * i * (1 - i), dc * c * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - a**2)), axis=1)
        gu += h.T @ dz[:, t]
        later, dc = dz[:, t] @ u.T, dc * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, gu, flat.sum(0)


if __name__ == "__main__":
    np.savez_compressed(Path(__file__).with_name("html_model.npz"), **train())
