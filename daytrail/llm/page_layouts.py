"""Labelled pages to train on: common layouts of sites, filled with made-up words.

Elements that hold main text carry `data-main`; all other text is not main. Layouts differ in which
parts there are, in their order, and in whether parts are named by tag, class or id.
"""

from __future__ import annotations

import random

SYLLABLES = "an ber con de el fa gro hin is ju ka lo mer nu or pa qui re sta tu ur ve win xa yo zen".split()


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.15:
            words[self.r.randrange(len(words))] = f'<a href="/{self.word()}">{self.word()}</a>'
        if self.r.random() < 0.15:
            words[self.r.randrange(len(words))] = f"<b>{self.word()}</b>"
        return " ".join(words).capitalize()

    def sentences(self, n: int) -> str:
        return " ".join(self.phrase(1, 18) + self.r.choice("....?!") for _ in range(n))

    def paragraph(self) -> str:
        return self.sentences(self.r.randint(1, 9))

    def named(self, tags: str, names: str, inner: str, marks: str = "") -> str:
        """`inner` in an element: named by its tag, or a plain one with a class, an id or a role."""
        tags_, names_ = tags.split(), names.split()
        tag = self.r.choice([*tags_, "div", "div", "section"])
        label = self.r.choice(names_)
        style = self.r.choice(["class", "class", "id"])
        label = self.r.choice([label, f"{label}-{self.word()}", f"{self.word()} {label}", f"site-{label}", label.capitalize()])
        plain = tag in tags_ and self.r.random() < 0.6
        return f"<{tag}{'' if plain else f' {style}=\"{label}\"'}{marks}>{inner}</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase(1, 3) if self.r.random() < 0.5 else self.word()}</a>' for _ in range(self.r.randint(low, high))]
        return self.r.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items)])

    def extra(self, kind: str) -> str:
        p = lambda: self.r.choice([f"<p>{self.paragraph()}</p>", self.sentences(1), f"<p>{self.sentences(2)}"])
        match kind:
            case "menu":
                return self.named("nav", "nav menu navbar navigation topnav", self.links())
            case "header":
                return self.named("header", "header masthead top brand", self.r.choice([f"<h1>{self.phrase(1, 3)}</h1>", self.phrase(1, 5), p()]) + self.r.choice(["", self.links()]))
            case "crumbs":
                return self.named("nav", "breadcrumb breadcrumbs crumbs", self.links(2, 4))
            case "advert":
                return self.named("aside", "ad ads advert advertisement sponsored promo banner adsense", p())
            case "notice":
                return self.named("dialog", "cookie notice consent gdpr popup alert banner", p() + self.r.choice(["", "<button>OK</button>"]))
            case "form":
                return f"<form action='/x'><label>{self.phrase(1, 3)}</label><input name=q>{self.r.choice(['', p()])}<button>{self.word()}</button></form>"
            case "subscribe":
                return self.named("form", "newsletter subscribe signup login search", p() + "<input><button>Go</button>")
            case "side":
                return self.named("aside", "sidebar side widget rail", f"<h3>{self.phrase(1, 3)}</h3>" + self.r.choice([p(), self.links(), p() + p()]))
            case "related":
                return self.named("aside", "related recommended more-stories trending popular", f"<h2>{self.phrase(1, 3)}</h2>" + self.links(3, 8))
            case "share":
                return self.named("menu", "share social follow", self.links(2, 5))
            case "comments":
                one = lambda: self.named("li", "comment reply response", f"<b>{self.word()}</b> {p()}")
                return self.named("section", "comments discussion disqus replies responses", f"<h3>{self.phrase(1, 2)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 6))))
            case _:
                return self.named("footer", "footer bottom colophon copyright legal", self.r.choice(["&copy; ", "© 2020 ", ""]) + self.r.choice([p(), self.phrase(2, 8) + " &middot; " + p(), self.links()]))

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.phrase(2, 12)}</h1>")
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12, 20])):
            match r.choice("ppppppppbbhlqtcg"):
                case "p":
                    out.append(f"<p>{self.paragraph()}" + r.choice(["</p>", "</p>", ""]))
                case "b":
                    out.append(f"<p><b>{self.paragraph()}<br>")
                case "h":
                    out.append(f"<h2>{self.phrase(1, 7)}</h2>")
                case "l":
                    out.append("<ul>" + "".join(f"<li>{self.phrase(2, 14)}" + r.choice([".", ""]) + "</li>" for _ in range(r.randint(2, 5))) + "</ul>")
                case "q":
                    out.append(f"<blockquote>{self.paragraph()}</blockquote>")
                case "t":
                    out.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.phrase(1, 5)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
                case "c":
                    out.append(f"<pre>{self.sentences(2)}</pre>")
                case _:
                    out.append(f"<figure><img src=x><figcaption>{self.phrase(2, 9)}</figcaption></figure>")
        body = "".join(out) or f"<p>{self.paragraph()}</p>"
        for kind in ("advert", "share", "subscribe"):
            if r.random() < 0.12:  # not main, though inside
                cut = body.find("<p>", len(body) // 2)
                if cut > 0:
                    return self.wrapped(body[:cut]) + self.extra(kind) + self.wrapped(body[cut:])
        return self.wrapped(body)

    def wrapped(self, body: str) -> str:
        return f"<div data-main>{body}</div>" if self.r.random() < 0.2 else f"<span data-main>{body}</span>"

    def page(self) -> str:
        r = self.r
        have = lambda p, *kinds: "".join(self.extra(k) for k in kinds if r.random() < p)
        main = self.main().replace("<span data-main>", "\0").replace("</span>", "")
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        name = r.choice(["", "", f' class="{r.choice("content article post entry story body text main".split())}"']) if tag in ("article", "main") else \
            f' {r.choice(["class", "id"])}="{r.choice("content article post entry story main-text".split())}"'
        pieces = main.split("\0")
        # Whatever stands between marked pieces is outside of them.
        inner = pieces[0] + "".join(f"<{tag}{name} data-main>{piece}</{tag}>" for piece in pieces[1:] if piece)
        before, after = have(0.6, "notice", "header", "menu", "crumbs") + have(0.45, "advert", "subscribe"), have(0.4, "share", "related", "comments", "side", "advert", "form")
        return (f"<!DOCTYPE html><html><head><title>{self.phrase(2, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
                f"{before}{inner}{after}{have(0.85, 'footer')}</body></html>")


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    pages = Pages(seed)
    return [pages.page() for _ in range(n)]
