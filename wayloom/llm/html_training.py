"""Trains the block labeller on generated pages: python -m wayloom.llm.html_training [steps].

Pages are built from many layouts (semantic tags or bare divs, tables, missing
end tags) with menus, headers, footers, sidebars, notices, adverts, forms,
related links and reader comments around and between the article's blocks. Each
block's label is known from the part that wrote it.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from .html_blocks import blocks
from .html_lstm import HIDDEN, PATH_SIZE, WEIGHTS, WORD_SIZE, fresh_weights, inputs, load_weights, run_lstm, scores, sigmoid

SYLLABLES = "the and er on in re th an en es ti ou ha le de la che sch ung heit que mente ción eau eux ment tion der ein ist und les des al or st ar ta ro mi".split()
COMMON = "the of and to in is that der die und das de la que el en et les un y los a it for".split()
MENU = "Home News About Contact Products Shop Login Help Search Archive Blog Start Kontakt Impressum Accueil Inicio Sports World".split()
FALLBACKS = ["Your browser does not support {}.", "Please enable JavaScript to see {}", "Download the {} file", "Ihr Browser kann {} nicht zeigen", "Votre navigateur ne lit pas {}"]
NOTICES = ["We use cookies to improve this site", "Accept all cookies", "Wir verwenden Cookies", "Ce site utilise des cookies", "Subscribe to our newsletter", "Sign up now", "This page was moved", "Please enable JavaScript"]
FOOTERS = ["© 2024 {}", "All rights reserved.", "Privacy policy · Terms", "© {} · {}", "Impressum | Datenschutz"]


class PageWriter:
    def __init__(self, seed):
        self.r = random.Random(seed)

    def word(self):
        r = self.r
        return r.choice(COMMON) if r.random() < 0.35 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    def sentence(self, low=3, high=18):
        words = [self.word() + ("," if self.r.random() < 0.07 else "") for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + "."

    def prose(self):
        n = 1 if self.r.random() < 0.3 else self.r.randint(1, 8)
        out = " ".join(self.sentence() for _ in range(n))
        if self.r.random() < 0.15:
            out = " ".join(w + self.r.choice(["***", "%%%", "&amp;&amp;&amp;", "$$$", "###", " |"]) for w in out.split())
        if self.r.random() < 0.08:
            out = out.replace(" ", " <b>", 1) + "</b>"
        if self.r.random() < 0.08:
            out += f' <a href="/x">{self.word()}</a> {self.sentence()}'
        if self.r.random() < 0.05:
            out = self.r.choice(["This work is licensed under the MIT License.", "Released under the terms of the GNU General Public License.", self.word() + "."])
        return out

    def attr(self, *names):
        r = self.r
        if r.random() < 0.1:
            return ""
        name = r.choice(names) + r.choice(["", "", "", "-box", "-wrap", "s", "-inner", "2"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def bad(self, html):
        return [(html, False)]

    def menu(self):
        r, items = self.r, []
        for _ in range(r.randint(3, 12)):
            label = r.choice(MENU) if r.random() < 0.4 else self.word()
            items.append(f'<li><a href="/{label}">{label}</a></li>' if r.random() < 0.85 else f'<a href="/{label}">{label}</a>')
        body = f"<ul>{''.join(items)}</ul>" if r.random() < 0.8 else "".join(items)
        return self.bad(r.choice([f"<nav>{body}</nav>", f"<nav{self.attr('nav', 'menu')}>{body}</nav>", f"<div{self.attr('nav', 'menu', 'navbar', 'breadcrumb', 'topbar', 'toc', 'tags')}>{body}</div>"]))

    def header(self):
        inner = self.r.choice([f"<h1>{self.word()}</h1>", f"<p>{self.sentence(2, 6)}</p>", f"<div>{self.word()} {self.word()}</div>", f"<a href='/'>{self.word()}</a>", self.sentence(2, 8), f"<h2>{self.sentence(2, 5)}</h2><p>{self.sentence()}</p>"])
        return self.bad(self.r.choice([f"<header>{inner}</header>", f"<header{self.attr('header', 'site', 'masthead')}>{inner}</header>", f"<div{self.attr('header', 'masthead', 'banner', 'logo', 'top')}>{inner}</div>"]))

    def footer(self):
        inner = self.r.choice(FOOTERS).format(self.word(), self.sentence()).replace("©", self.r.choice(["©", "&copy;"])).replace("·", "&middot;")
        inner = self.r.choice([inner, f"<p>{inner}</p>", f"<p>{inner}</p><p>{self.sentence()}</p>", f"<div>{self.sentence()}</div>{inner}"])
        return self.bad(self.r.choice([f"<footer>{inner}</footer>", f"<footer{self.attr('footer', 'site')}>{inner}</footer>", f"<div{self.attr('footer', 'bottom', 'copyright', 'legal')}>{inner}</div>"]))

    def sidebar(self):
        inner = "".join(self.r.choice([f"<h3>{self.sentence(1, 4)}</h3>", f"<p>{self.prose()}</p>", f"<li><a href='/a'>{self.sentence(3, 9)}</a></li>", f"<div>{self.sentence()}</div>"]) for _ in range(self.r.randint(1, 5)))
        return self.bad(self.r.choice([f"<aside>{inner}</aside>", f"<aside{self.attr('sidebar', 'widget', 'related')}>{inner}</aside>", f"<div{self.attr('sidebar', 'side', 'widget', 'related', 'recommended', 'trending', 'popular', 'more')}>{inner}</div>", f"<section{self.attr('related', 'sidebar', 'recommended')}>{inner}</section>"]))

    def notice(self):
        inner = self.r.choice([self.r.choice(NOTICES), self.sentence(), f"<p>{self.sentence()}</p>", f"<p>{self.r.choice(NOTICES)}</p>"])
        return self.bad(f"<{(t := self.r.choice(['div', 'div', 'section', 'p', 'aside']))}{self.attr('cookie', 'notice', 'consent', 'banner', 'alert', 'gdpr', 'popup', 'modal', 'newsletter', 'subscribe', 'promo', 'warning', 'message') or ' class=notice'}>{inner}</{t}>")

    def advert(self):
        inner = self.r.choice([self.sentence(), " ".join(self.sentence() for _ in range(3)), f"<p>{self.sentence()}</p>", f"<a href='/ad'>{self.sentence(2, 6)}</a>"])
        return self.bad(f"<{(t := self.r.choice(['div', 'div', 'section', 'aside', 'p']))}{self.attr('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'banner', 'adslot') or ' class=ad'}>{inner}</{t}>")

    def control(self):
        """Buttons, lists to choose from and what players show where they can't play, between or inside other parts."""
        r = self.r
        fallback = r.choice(FALLBACKS).format(self.word())
        return self.bad(r.choice([
            f"<button{self.attr('btn', 'share', 'toggle')}>{r.choice(MENU) if r.random() < 0.5 else self.sentence(1, 3)}</button>",
            f"<select name=s>{''.join(f'<option>{self.word()}</option>' for _ in range(r.randint(1, 5)))}</select>",
            f"<{(t := r.choice(['video', 'audio', 'canvas']))} src=x>{fallback}</{t}>",
            f"<{(t := r.choice(['video', 'object', 'audio']))}><p>{fallback}</p></{t}>",
            f"<noscript>{r.choice([fallback, self.sentence(3, 8), f'<p>{fallback}</p>'])}</noscript>",
        ]))

    def form(self):
        inner = self.r.choice([f"<select>{''.join(f'<option>{self.word()}</option>' for _ in range(3))}</select><button>{self.word()}</button>", f"<label>{self.word()}</label><input name=q>", f"<p>{self.sentence(2, 8)}</p><input type=email>", f"{self.sentence(1, 4)}<input><button>{self.word()}</button>", f"<fieldset><legend>{self.word()}</legend><label>{self.sentence(1, 5)}</label></fieldset>", f"<div>{self.sentence()}</div>"])
        return self.bad(f"<form{self.attr('search', 'login', 'subscribe', 'contact', 'form')} action='/go'>{inner}</form>")

    def comments(self):
        one = lambda: self.r.choice([f"<div class='comment'><p>{self.prose()}</p></div>", f"<li class='comment'>{self.prose()}</li>", f"<div class='reply'><span>{self.word()}</span><p>{self.prose()}</p></div>", f"<p>{self.prose()}</p>", f"<article class='comment'><h4>{self.word()}</h4><p>{self.prose()}</p></article>"])
        inner = "".join(one() for _ in range(self.r.randint(1, 6)))
        head = self.r.choice(["", f"<h3>{self.r.choice(['Comments', 'Kommentare', 'Responses', 'Commentaires', 'Comentarios'])}</h3>"])
        tag = self.r.choice(["section", "div", "div", "ol", "aside"])
        return self.bad(f"<{tag}{self.r.choice([' id', ' class'])}=\"{self.r.choice(['comments', 'comment-list', 'disqus', 'responses', 'discussion', 'reader-comments', 'replies'])}\">{head}{inner}</{tag}>")

    def share(self):
        return self.bad(f"<div{self.attr('share', 'social', 'tags', 'meta', 'byline', 'author')}>{self.r.choice(['Share on Twitter', 'Facebook', self.sentence(2, 5), '<a href=/s>Share</a> <a href=/t>Tweet</a>'])}</div>")

    def article(self):
        r, parts = self.r, []
        title = self.sentence(2, 12)
        if r.random() < 0.75:
            parts.append((f"<h1>{title}</h1>", True))
        for k in range(1 if r.random() < 0.2 else r.randint(1, 14)):
            u = r.random()
            if u < 0.08:
                parts.append((f"<p>{' '.join(self.word() for _ in range(r.randint(1, 3))).capitalize()}{r.choice(['.', '.', ''])}</p>", True))
            elif u < 0.72:
                parts.append((r.choice([f"<p>{self.prose()}</p>"] * 6 + [f"<p>{self.prose()}", f"<p><b>{self.prose()}<br>", f"<div>{self.prose()}</div>", f"<p>{self.prose()} <math><mi>x</mi><mo>+</mo><mn>{r.randint(1, 9)}</mn></math> {self.sentence()}</p>", f"<object data=x><p>{self.prose()}</p></object>"]), True))
            elif u < 0.8:
                parts.append((f"<h{r.randint(2, 4)}>{self.sentence(1, 7)}</h2>".replace("</h2>", ""), True))
            elif u < 0.88:
                parts.append(("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>", True))
            elif u < 0.92:
                parts.append((r.choice([f"<blockquote>{self.prose()}</blockquote>", f"<pre>{self.prose()}</pre>", f"<figure><figcaption>{self.sentence()}</figcaption></figure>", f"<table><tr><td>{self.word()}<td>{self.sentence()}</table>"]), True))
            elif k:
                parts += r.choice([self.advert, self.share, self.notice, self.sidebar, self.form, self.control])()
        shell = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        names = self.attr("content", "post", "article", "entry", "main", "story", "body", "text", "post-content", "article-body", "prose")
        before, after = ("<table><tr>", "</tr></table>") if shell == "td" else ("", "")
        if r.random() < 0.25:
            before, after = before + f"<{'main' if shell != 'main' else 'div'}>", f"</{'main' if shell != 'main' else 'div'}>" + after
            before, after = (before, after) if shell != "td" else ("<table><tr>", "</tr></table>")
        if r.random() < 0.08:  # bare paragraphs
            return parts
        return [(f"{before}<{shell}{names if shell != 'article' or r.random() < 0.4 else ''}>", None), *parts, (f"</{shell}>{after}", None)]

    def page(self):
        """A page, and the label of each of its blocks."""
        r = self.r
        pick = lambda kinds, p: [f() for f in kinds if r.random() < p]
        above = pick([self.header, self.menu, self.notice, self.advert, self.form], 0.4)
        above += pick([self.control], 0.15)
        below = pick([self.comments, self.sidebar, self.share, self.advert, self.form, self.notice, self.menu, self.control], 0.3)
        r.shuffle(above)
        r.shuffle(below)
        if r.random() < 0.05:  # a fragment: paragraphs and perhaps a button, without a page around them
            own = [(f"<p>{self.prose() if r.random() < 0.5 else self.sentence(1, 3)[: r.choice([-1, None])].lower()}</p>", True) for _ in range(r.randint(1, 5))]
            own.insert(r.randint(0, len(own)), self.control()[0] if r.random() < 0.4 else ("", None))
            return self.labelled("".join(p if good is None else mark(p, good) for p, good in own))
        parts = [p for group in [*above, self.article() if r.random() < 0.97 else [], *below, *([self.footer()] if r.random() < 0.8 else [])] for p in group]
        head = f"<!DOCTYPE html><html><head><title>{self.word()}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>" if r.random() < 0.9 else ""
        wrap = r.choice(["", "", "", "<div id='page'>", "<div class='container'>", "<div class='wrapper'>"])
        marked = head + wrap + "".join(p if good is None else mark(p, good) for p, good in parts) + ("</body></html>" if r.random() < 0.8 else "")
        return self.labelled(marked)

    @staticmethod
    def labelled(marked):
        found = blocks(marked)
        labels = [YES in b[1] for b in found]
        plain = [(path, text.replace(YES, "").replace(NO, "").strip(), n) for path, text, n in found]
        kept = [(b, y) for b, y in zip(plain, labels, strict=True) if b[1]]
        return [b for b, _ in kept], np.array([y for _, y in kept], dtype=np.float32)


YES, NO = "", ""  # label marks in generated text, taken out again


def mark(html: str, good: bool) -> str:
    """html with a label mark at the start of each of its texts."""
    return re.sub(r"(>)([^<]*[^<\s][^<]*)", lambda m: m[1] + (YES if good else NO) + m[2], html) if html.startswith("<") else (YES if good else NO) + html


def gradients(pages, labels, w):
    x, mask, time, page, (path, path_of, pn, word, word_of, wn) = inputs(pages, w)
    fwd, fs = run_lstm(x, mask, w["fx"], w["fh"], w["fc"], keep=True)
    bwd, bs = run_lstm(x[::-1], mask[::-1], w["bx"], w["bh"], w["bc"], keep=True)
    states = np.concatenate([fwd, bwd[::-1]], axis=2)
    p = sigmoid(states @ w["out"] + w["out_b"])
    y = np.zeros_like(mask)
    y[time, page] = np.concatenate(labels)
    err = (p - y) * mask / mask.sum()
    loss = -float((mask * np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-7, 1))).sum() / mask.sum())
    g = {"out": np.einsum("tp,tph->h", err, states), "out_b": np.array([err.sum()])}
    d_state = err[:, :, None] * w["out"]
    dx = np.zeros_like(x)
    for d, saved, xs, ds in (("f", fs, x, d_state[:, :, :HIDDEN]), ("b", bs, x[::-1], d_state[::-1, :, HIDDEN:])):
        wh = w[d + "h"]
        gx, gh, gc = np.zeros_like(w[d + "x"]), np.zeros_like(wh), np.zeros_like(w[d + "c"])
        dh, dc, dxs = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros_like(x)
        for t in range(x.shape[0] - 1, -1, -1):
            i, f, o, gg, c, tc, h, m = saved[t]
            dh = dh + ds[t]
            a, b = m * dh, m * dc
            do = a * tc
            dcn = b + a * o * (1 - tc**2)
            dz = np.concatenate([dcn * gg * i * (1 - i), dcn * c * f * (1 - f), do * o * (1 - o), dcn * i * (1 - gg**2)], axis=1)
            gx += xs[t].T @ dz
            gh += h.T @ dz
            gc += dz.sum(axis=0)
            dxs[t] = dz @ w[d + "x"].T
            dh = dz @ wh.T + (1 - m) * dh
            dc = dcn * f + (1 - m) * dc
        g |= {d + "x": gx, d + "h": gh, d + "c": gc}
        dx += dxs if d == "f" else dxs[::-1]
    flat = dx[time, page]
    for name, slots, owner, count, cols in (("path", path, path_of, pn, slice(0, PATH_SIZE)), ("word", word, word_of, wn, slice(PATH_SIZE, PATH_SIZE + WORD_SIZE))):
        each = flat[:, cols] / np.sqrt(count)[:, None]
        g[name] = np.stack([np.bincount(slots, weights=each[owner, k], minlength=len(w[name])) for k in range(each.shape[1])], axis=1)
    return loss, g


def train(steps: int, seed: int = 5, together: int = 24) -> dict:
    w = fresh_weights(seed)
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        made = [PageWriter(f"{seed}/{step}/{k}").page() for k in range(together)]
        made = [m for m in made if m[0]]
        loss, g = gradients([m[0] for m in made], [m[1] for m in made], w)
        rate = 0.01 * min(1, step / 50) * (0.1 ** (step / steps))
        for k in w:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.995 * second[k] + 0.005 * g[k] ** 2
            w[k] = (w[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-6)).astype(np.float32)
        if step % 200 == 0:
            print(step, round(loss, 4), flush=True)
    return w


def held_out(w: dict, pages: int = 400, seed: int = 99) -> tuple[float, float]:
    """Shares of blocks and of whole pages labelled right, on pages that training didn't use."""
    made = [m for m in (PageWriter(f"held/{seed}/{k}").page() for k in range(pages)) if m[0]]
    right = [(s > 0) == (m[1] > 0) for s, m in zip(scores([m[0] for m in made], w), made, strict=True)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    trained = train(int(sys.argv[1]) if len(sys.argv) > 1 else 2500)
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in trained.items()})
    print(held_out(load_weights()))
