"""Labelled pages to train extraction on: layouts drawn from a seed, every block known as article text or not.

The pages are made of invented words, so that what is learned are the elements
around a block and the shape of its text, not its language. A share of the
containers carries names without meaning, so that neighbours and shape count.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

# Names that web pages give to the parts of a page.
ARTICLE_NAMES = """content main-content article article-body post post-content entry entry-content story story-body body-text
text page-content blog-post news-text single-post articleBody maintext""".split()
PARTS = {
    "menu": "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs pagination pager toc-links tabs".split(),
    "head": "header masthead site-header topbar banner-top branding logo skip-link toolbar".split(),
    "foot": "footer site-footer copyright colophon bottom legal imprint credits".split(),
    "side": "sidebar side widget aside right-column left-column secondary rail related related-posts recommended more-stories "
            "trending popular tags tagcloud share social sharing follow-us archive-links".split(),
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert popup modal newsletter subscribe signup promo "
              "paywall overlay toast disclaimer hidden".split(),
    "ad": "ad ads advert advertisement sponsor sponsored banner adbox promotion dfp-ad".split(),
    "form": "search search-form login contact-form feedback newsletter-form poll survey".split(),
    "talk": "comments comment comment-list comments-area replies respond discussion disqus reader-comments user-comments "
            "reviews guestbook".split(),
}
SIGNS = ["&copy;", "&raquo;", "&middot;", "|", "&lt;3", "*", "###", "$$$", "%%%"]
SYLLABLES = "an ber chi dra el fo gu hin is ka lo mé nor ou pra qui ru sté ti ür vo wen ya zü".split()


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.serial, self.truth = rng, 0, {}
        self.meaningless = rng.random() < 0.12

    def words(self, least: int, most: int, end: float = 0.7) -> str:
        rng = self.rng
        junk = rng.random() < 0.12
        made = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) + (rng.choice(["***", "%%%", "###"]) if junk else "")
                for _ in range(rng.randint(least, most))]
        made[0] = made[0].capitalize()
        for i in range(1, len(made)):
            if rng.random() < 0.08:
                made[i - 1] += rng.choice([",", ".", ";"])
        return " ".join(made) + (rng.choice([".", "!", "?", "."]) if rng.random() < end else "")

    def block(self, text: str, wanted: bool) -> str:
        """The text with a serial word, under which its label is known."""
        self.serial += 1
        mark = f"b{self.serial}b"
        self.truth[mark] = wanted
        place = self.rng.randrange(2)
        return f"{mark} {text}" if place else f"{text} {mark}"

    def named(self, names: list[str]) -> str:
        if self.meaningless and self.rng.random() < 0.6:
            return f' class="{"".join(self.rng.choices(SYLLABLES, k=3))}-{self.rng.randrange(99)}"'
        key = self.rng.choice(["class", "class", "id"])
        extra = self.rng.choice(["", "", " box", " col-8", " clearfix", " row"]) if key == "class" else ""
        return f' {key}="{self.rng.choice(names)}{extra}"'

    def links(self, wanted: bool = False) -> str:
        rng = self.rng
        items = [f'<a href="/{i}">{self.block(self.words(1, rng.choice([1, 2, 6]), 0.1), wanted)}</a>'
                 for i in range(rng.randint(1, 8))]
        style = rng.randrange(3)
        if style == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" if style == 1 else f"<p>{x}</p>" for x in items)

    def aside(self, kind: str) -> str:
        """A part that is not the article."""
        rng, names = self.rng, self.named(PARTS[kind])
        sentence = lambda: self.block(self.words(2, rng.choice([6, 14, 40])), False)
        if kind == "menu":
            return rng.choice(["<nav>{}</nav>", f"<div{names}>{{}}</div>", f"<nav{names}>{{}}</nav>", f"<div role=navigation{names}>{{}}</div>"]).format(self.links())
        if kind == "head":
            inner = sentence() if rng.random() < 0.5 else f"<div>{sentence()}</div>{self.links()}"
            return rng.choice(["<header>{}</header>", f"<div{names}>{{}}</div>", f"<header{names}>{{}}</header>"]).format(inner)
        if kind == "foot":
            inner = rng.choice([f"&copy; {sentence()}", sentence(), f"<p>{SIGNS[0]} {sentence()}</p>{self.links()}",
                                f"<p>{sentence()}</p><p>{sentence()}</p>"])
            return rng.choice(["<footer>{}</footer>", "<footer>{}</footer>", f"<div{names}>{{}}</div>"]).format(inner)
        if kind == "side":
            inner = "".join(rng.choice([lambda: f"<h3>{sentence()}</h3>", self.links, lambda: f"<p>{sentence()}</p>"])()
                            for _ in range(rng.randint(1, 3)))
            return rng.choice(["<aside>{}</aside>", f"<aside{names}>{{}}</aside>", f"<div{names}>{{}}</div>", f"<section{names}>{{}}</section>"]).format(inner)
        if kind == "form":
            return f"<form{names}><label>{sentence()}</label><input type=text><p>{sentence()}</p><button>Go</button></form>"
        if kind == "talk":
            one = lambda: rng.choice(["<li>{}</li>", "<div class=comment>{}</div>", "<article class=comment>{}</article>", "<p>{}</p>"]).format(
                rng.choice([sentence(), f"<p>{sentence()}</p><p>{sentence()}</p>"]))
            return rng.choice([f"<div{names}>{{}}</div>", f"<section{names}>{{}}</section>", f"<ol{names}>{{}}</ol>"]).format(
                (f"<h3>{sentence()}</h3>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 5))))
        if rng.random() < 0.2:
            return f"<p{names}>{sentence()}</p>"
        inner = rng.choice([sentence(), f"<p>{sentence()}</p>", f"{sentence()}<a href=#>ok</a>"])
        return rng.choice([f"<div{names}>{{}}</div>", f"<div{names}>{{}}</div>", f"<section{names}>{{}}</section>"]).format(inner)

    def article(self, bare: bool = False) -> str:
        """The parts of an article in order, now and then with something foreign between them."""
        rng, out = self.rng, []
        if rng.random() < 0.85:
            heading = f"<h1>{self.block(self.words(1, 12, 0.3), True)}</h1>"
            out.append(f"<header>{heading}</header>" if rng.random() < 0.1 else heading)
        short = rng.random() < 0.3
        for _ in range(rng.choice([1, 2, 4, 8, 16])):
            text = lambda: self.block(self.words(1, 6 if short else rng.choice([3, 30, 90]), 0.75), True)
            out.append(rng.choices(
                [lambda: f"<p>{text()}</p>", lambda: f"<p><b>{text()}<br>", lambda: f"<p>{text()}",
                 lambda: f"<h2>{text()}</h2><p>{text()}</p>", lambda: "<ul>" + "".join(f"<li>{text()}</li>" for _ in range(3)) + "</ul>",
                 lambda: f"<blockquote>{text()}</blockquote>", lambda: f"<p>{text()} <a href=/x>{self.words(1, 3, 0)}</a></p>",
                 lambda: f"<table><tr><td>{text()}</td><td>{text()}</td></tr></table>", lambda: f"<pre>{text()}</pre>",
                 lambda: f"<figure><img src=a><figcaption>{text()}</figcaption></figure>", lambda: f"<div>{text()}</div>",
                 lambda: self.aside(rng.choice(["ad", "side", "notice", "form"]))],
                [12, 3, 4, 2, 1, 1, 2, 1, 1, 1, 2, 0.8])[0]())
        for kind, share in (("talk", 0.25), ("foot", 0.08), ("side", 0.08)):
            if not bare and rng.random() < share:
                out.append(self.aside(kind))
        return "".join(out)

    def whole(self) -> str:
        rng = self.rng
        names = self.named(ARTICLE_NAMES)
        style = rng.randrange(21) // 2
        inner = self.article() if style < 10 else ""
        if style < 4:
            core = f"<article>{inner}</article>"
        elif style == 4:
            core = f"<main><article{names}>{inner}</article></main>"
        elif style == 5:
            core = f"<main{names}>{inner}</main>"
        elif style < 9:
            core = f"<div{names}>{inner}</div>"
        elif style == 9:
            core = rng.choice([f"<section{names}>{inner}</section>", f"<table><tr><td{names}>{inner}</td></tr></table>"])
        else:
            core = self.article(bare=True)
        before = [self.aside(k) for k in rng.sample(["head", "menu", "ad", "notice", "form", "side"], rng.randint(0, 3))]
        after = [self.aside(k) for k in rng.sample(["talk", "side", "ad", "form", "notice", "menu"], rng.randint(0, 3))]
        if rng.random() < 0.8:
            after.append(self.aside("foot"))
        page = "".join([*before, core, *after])
        if rng.random() < 0.3:
            page = f"<div{rng.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{page}</div>"
        return ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>" + page
                + (rng.choice(["</body></html>", ""])))


def labelled_pages(count: int, seed: int = 0) -> Iterator[tuple[str, dict[str, bool]]]:
    """Pages and, by the serial word in each block, whether it belongs to the article."""
    rng = random.Random(seed)
    for _ in range(count):
        page = _Page(rng)
        yield page.whole(), page.truth
