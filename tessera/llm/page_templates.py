"""Made pages with known main text, for learning: many layouts, invented words.

labelled_pages() gives, with each page, a function that tells a main run of text from others.
"""

from __future__ import annotations

import html
import random
from collections.abc import Callable, Iterator

_SYLLABLES = "ba ce di fo gu han jel kin lor mun nas per qui ros sti tra ung vel wo xe ya zu ent ion ing er al ous".split()


class Maker:
    def __init__(self, rng: random.Random):
        self.rng, self.main, self.noise = rng, set(), rng.random() < 0.15

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high))]
        if r.random() < 0.15:
            out = [r.choice([w, w[0], str(len(w))]) for w in out]
        if self.noise:
            out = [w + r.choice("!#$%&*+-=@^_|~") * r.randint(1, 4) for w in out]
        elif r.random() < 0.7:
            for i in range(7, len(out), r.randint(6, 14)):
                out[i] += r.choice([".", ",", "."])
            out[-1] += r.choice([".", ".", "", "!"])
        out[0] = out[0].capitalize()
        return " ".join(out)

    def say(self, low: int, high: int, main: bool) -> str:
        text = self.words(low, high)
        if main:
            self.main.add(text)
        return html.escape(text, quote=self.rng.random() < 0.5)

    def tag(self, name: str, inner: str, tokens: str = "") -> str:
        r = self.rng
        attribute = ""
        if tokens and r.random() < 0.9:
            token = r.choice(tokens.split())
            token = r.choice([token, token, token + r.choice(["-box", "-wrap", "_area", " clearfix", "-1"]), r.choice(["site-", "page-", "col-"]) + token])
            attribute = f' {r.choice(["class", "class", "id"])}="{token}"'
        return f"<{name}{attribute}>{inner}</{name}>"

    def links(self, tokens: str, name: str) -> str:
        r = self.rng
        items = [f'<a href="/{i}">{self.say(1, 3, False)}</a>' for i in range(r.randint(3, 10))]
        inner = r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()
        return self.tag(name, inner, tokens)

    def box(self, tokens: str, names=("div", "div", "section", "aside")) -> str:
        """Something that isn't main text but often reads like it."""
        r = self.rng
        inner = "".join(r.choice([lambda: self.tag("p", self.say(3, 45, False)), lambda: self.say(2, 20, False), lambda: self.tag("h3", self.say(1, 5, False)), lambda: self.tag("div", self.say(2, 25, False))])() for _ in range(r.randint(1, 4)))
        return self.tag(r.choice(names), inner, tokens)

    def form(self) -> str:
        return f"<form action='/s'>{self.tag('label', self.say(1, 3, False))}<input name='q'>{self.tag('p', self.say(2, 12, False))}<button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        r = self.rng
        one = lambda: r.choice([lambda: self.tag("li", self.tag("p", self.say(3, 60, False))), lambda: self.tag("div", self.tag("b", self.say(1, 2, False)) + self.tag("p", self.say(3, 60, False)), "comment reply"), lambda: self.tag("article", self.tag("p", self.say(3, 60, False)), "comment")])()
        return self.tag(r.choice(["section", "div", "div", "ol"]), self.tag("h2", self.say(1, 3, False)) + "".join(one() for _ in range(r.randint(1, 6))), "comments commentlist discussion replies responses" if r.random() < 0.95 else "comments")

    def paragraph(self) -> str:
        r = self.rng
        text = self.say(1, r.choice([1, 3, 12, 40, 120, 400]), True)
        kind = r.random()
        if kind < 0.12:
            return f"<p><b>{text}<br>"
        if kind < 0.2:
            return f"<p>{text}"
        if kind < 0.3:
            return f"<p><{(t := r.choice(['b', 'em', 'span', 'strong']))}>{text}</{t}></p>"
        if kind < 0.36:
            return f'<p><a href="/x">{text}</a></p>'
        return f"<p>{text}</p>"

    def article(self) -> str:
        r = self.rng
        parts = [f"<h1>{self.say(2, 12, True)}</h1>"] if r.random() < 0.75 else []
        for _ in range(r.choice([0, 1, 2, 5, 9, 20]) if parts else r.choice([1, 2, 5, 9, 20])):
            k = r.random()
            if k < 0.76:
                parts.append(self.paragraph())
            elif k < 0.82:
                parts.append(self.tag(r.choice(["h2", "h3"]), self.say(1, 8, True)))
            elif k < 0.87:
                parts.append(self.tag(r.choice(["ul", "ol"]), "".join(self.tag("li", self.say(1, 20, True)) for _ in range(r.randint(1, 6)))))
            elif k < 0.9:
                parts.append(self.tag(r.choice(["blockquote", "pre"]), self.say(3, 40, True)))
            elif k < 0.92:
                parts.append("<table>" + "".join("<tr>" + "".join(self.tag("td", self.say(1, 4, True)) for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif k < 0.94:
                parts.append(self.tag("div", self.say(5, 60, True)))
            elif k < 0.97:
                parts.append(self.box("ad ads advert advertisement sponsored promo banner", ("div", "div", "aside")))
            elif k < 0.98:
                parts.append(self.box("share social related newsletter subscribe recommended"))
            else:
                parts.append(self.tag("aside", self.say(3, 30, False), "sidebar related"))
        if r.random() < 0.12:
            parts.insert(0, self.tag("header", r.choice([self.say, lambda *x: self.tag("p", self.say(*x))])(1, 10, False)))
        if r.random() < 0.08:
            parts.insert(r.randint(0, 1), self.links("", "nav"))
        if r.random() < 0.12:
            parts.append(self.tag("footer", r.choice([self.say, lambda *x: self.tag("p", self.say(*x))])(1, 14, False)))
        if r.random() < 0.08:
            parts.append(r.choice([self.comments, self.form])())
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.5:
            whole = self.tag("article", inner, "post entry story" if r.random() < 0.3 else "")
        elif kind < 0.55:
            return inner if r.random() < 0.5 else self.tag("div", inner)
        elif kind < 0.7:
            whole = f"<main>{self.tag('div', inner) if r.random() < 0.5 else inner}</main>"
        else:
            whole = self.tag(r.choice(["div", "div", "section"]), inner, "content article post entry story text body")
        return self.tag("div", whole, "main content wrapper container") if r.random() < 0.3 else whole

    def page(self) -> str:
        r, chance = self.rng, lambda p: self.rng.random() < p
        top = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>"]
        if chance(0.35):
            top.append(self.tag("header", self.tag(r.choice(["h1", "div", "p"]), self.say(1, 5, False)) + (self.links("menu nav", "nav") if chance(0.3) else "")) if chance(0.6) else self.tag("div", self.say(1, 6, False), "header masthead topbar branding"))
        if chance(0.8):
            top.append(self.links("", "nav") if chance(0.7) else self.links("nav menu navbar breadcrumb navigation", r.choice(["div", "ul"])))
        if chance(0.3):
            top.append(self.box("cookie consent notice alert gdpr popup notification", ("div", "div", "section")))
        if chance(0.6):
            top.append(f"<!-- ad {r.randint(0, 99)} -->" + r.choice([lambda: self.tag("div", self.say(2, 25, False), "ad ads advert advertisement banner sponsored"), lambda: self.box("ad ads advert banner sponsored promo")])())
        side = (self.box("sidebar widget related", ("aside",)) if chance(0.5) else self.links("sidebar related widget archive categories", r.choice(["div", "aside"]))) if chance(0.4) else ""
        body = [self.article()]
        body.insert(0 if chance(0.4) else 1, side)
        if chance(0.25):
            body.append(self.comments())
        if chance(0.2):
            body.append(self.form())
        if chance(0.2):
            body.append(self.box("ad advert newsletter signup related share"))
        inner = "".join(body)
        if chance(0.2):
            inner = self.tag("div", inner, "wrapper container page layout")
        end = ["<footer>&copy; " + self.say(1, 12, False) + "</footer>" if chance(0.7) else self.box("footer copyright legal bottom", ("div",))] if chance(0.85) else []
        return "".join(top) + inner + "".join(end) + ("</body></html>" if chance(0.8) else "")


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, Callable[[str], bool]]]:
    rng = random.Random(seed)
    for _ in range(n):
        maker = Maker(rng)
        source = maker.page()
        main = {" ".join(t.split()) for t in maker.main}
        yield source, main.__contains__
