"""The labelled table of the main-text classifier.

Each page is a skeleton: ``{n}`` stands for n words, ``{n.}`` for n words that end in a full stop,
``{n@}`` for n words inside a link. Elements with ``y=1`` are main text, all others are not. Some
skeletons are written out, others are drawn from kinds of pages.
"""

from __future__ import annotations

import random
import re

SKELETONS: tuple[str, ...] = (
    # articles in article elements: every length of block, every neighbour
    "<nav><ul><li>{1@}</li><li>{2@}</li><li>{1@}</li></ul></nav><div class=ad>{8.}</div><article y=1><h1>{12}</h1><p>{40.}</p><p>{3.}</p><p>{90.}</p></article><footer>{6.}</footer>",
    "<nav><a href=#>{1@}</a></nav><article y=1><h1>{6}</h1><p>{12.}</p></article><footer>{20.}</footer>",
    "<nav><ul><li>{1@}</li></ul></nav><div class=ad>{25.}</div><article y=1><h1>{2}</h1></article><footer>{2}</footer>",
    "<header><a href=/>{2@}</a><p>{4}</p></header><main><article y=1><h1>{5}</h1><p>{1.}</p><p>{2.}</p><p>{1}</p><ul><li>{3}</li><li>{9.}</li></ul><p>{60.}</p></article></main><aside><p>{30.}</p><p>{4@}</p></aside><footer><p>{9.}</p></footer>",
    "<article y=1><h1>{9}</h1><h2>{4}</h2><p>{15.} {6@}</p><p>{5@}</p><p>{70.}</p><blockquote>{22.}</blockquote></article><section id=comments><h2>{1}</h2><article class=comment><p>{35.}</p></article><article class=comment><p>{3.}</p></article></section>",
    "<article y=1><p>{200.}</p><p>{1}</p><table><tr><td>{1}</td><td>{4}</td></tr></table><pre>{12}</pre></article><div class=comments><p>{60.}</p><p>{12.}</p></div><div class=related><h3>{2}</h3><a href=#>{8@}</a></div>",
    "<div class=cookie-notice><p>{28.}</p></div><article y=1><h1>{7}</h1><div class=advert y=0>{10.}</div><p>{33.}</p><aside y=0>{18.}</aside><p>{8.}</p><div class=share y=0>{2@}</div></article><div id=sidebar><p>{44.}</p><ul><li>{3@}</li></ul></div>",
    "<div>{20.}</div><article y=1><h1>{3}</h1><p>{20.}</p></article><div>{20.}</div><p>{50.}</p><p>{4}</p>",
    "<p>{6.}</p><article y=1><p>{6.}</p><div>{30.}</div><div>{2.}</div></article><p>{70.}</p><div>{3@}</div>",
    "<article y=1><header y=1><h1>{8}</h1></header><p>{45.}</p><p>{10.}</p><footer y=0><p>{12.}</p></footer></article>",
    "<main y=1><h1>{8}</h1><p>{45.}</p><p>{2.}</p><p>{1}</p><nav y=0>{3@}</nav><p>{100.}</p></main><div>{12.}</div><footer>{30.}</footer>",
    "<main y=1><p>{5.}</p><section><h2>{2}</h2><p>{80.}</p><div class=newsletter y=0><p>{20.}</p></div></section></main><div class=banner>{9}</div>",
    # containers that only their names tell
    "<div class=header><a href=/>{2@}</a></div><div class=content y=1><h1>{7}</h1><p>{30.}</p><p>{2.}</p><p>{9.}</p></div><div class=footer>{12.}</div>",
    "<div id=menu><p>{2@}</p><p>{1@}</p></div><div id=main-content y=1><h2>{3}</h2><p>{55.}</p><p>{6.}</p><div class=ads y=0>{15.}</div><p>{1}</p></div><div class=sidebar><p>{40.}</p></div><div class=comment-list><p>{25.}</p></div>",
    "<div class=topbar><p>{3}</p></div><div class=entry y=1><p>{18.}</p><p>{4.}</p><p>{120.}</p></div><div class=widget><p>{22.}</p></div><div class=promo><p>{14.}</p></div>",
    "<div class=post-body y=1><p>{3.}</p><p>{35.}</p><p>{1}</p></div><div class=notice>{40.}</div><div class=copyright>{7.}</div><div class=pagination>{3@}</div>",
    # nothing but the text itself
    "<p>{1@}</p><p>{2@}</p><h1 y=1>{7}</h1><p y=1>{50.}</p><p y=1>{35.}</p><p y=1>{18.}</p><p y=1>{64.}</p><p>{2@}</p><p>{3}</p>",
    "<div>{2@}</div><div>{1@}</div><div>{3@}</div><div y=1>{80.}</div><div y=1>{45.}</div><div>{4@}</div><div>{2}</div><div>{1@}</div>",
    "<table><tr><td>{2@}</td><td>{1@}</td></tr></table><h1 y=1>{5}</h1><p y=1>{28.}</p><p y=1>{14.}</p><p y=1>{31.}</p><p>{3}</p><p>{4@}</p>",
    "<ul><li>{2@}</li><li>{3@}</li><li>{2@}</li></ul><p y=1>{22.}</p><p y=1>{75.}</p><p y=1>{16.}</p><ul><li>{4@}</li><li>{2@}</li></ul><p>{2}</p>",
    "<h1 y=1>{4}</h1><p y=1>{24.}</p><h2 y=1>{3}</h2><p y=1>{40.}</p><p y=1>{90.}</p><p>{1@}</p><p>{5@}</p>",
    "<div>{2@}</div><h1 y=1>{4}</h1><p y=1>{50.}</p><p y=1>{2.}</p><p y=1>{45.}</p><p y=1>{1.}</p><p y=1>{60.}</p><p>{4}</p>",
    "<p y=1>{25.}</p><p y=1>{3.}</p><p y=1>{30.}</p><ul><li>{1@}</li></ul><p>{3}</p>",
    "<h3>{1}</h3><ul><li>{2@}</li><li>{1@}</li></ul><p y=1>{19.}</p><p y=1>{2.}</p><p y=1>{38.}</p><h3>{1}</h3><ul><li>{2@}</li></ul><p>{2}</p>",
    "<p y=1>{30.}</p><p y=1>{12.}</p><p y=1>{26.}</p>",
    "<h1 y=1>{6}</h1><p y=1>{11.}</p>",
    "<p y=1>{9.}</p>",
)

#: Words that fill the skeletons; only their number matters.
_FILL = ("stone", "river", "under", "the", "bright", "morning", "walks", "and", "early", "birds", "sing", "softly")

#: Pages of each kind that are drawn, and where their drawing starts.
DRAWN, SEED = 500, 7
_BOILER = ("class=ad", "class=cookie-notice", "class=sidebar", "class=footer", "class=banner", "class=newsletter", "class=widget", "id=related", "class=disclaimer", "class=comments")


def _menu(r: random.Random) -> str:
    items = "".join(f"<li>{{{r.randint(1, 4)}@}}</li>" for _ in range(r.randint(3, 8)))
    return r.choice((f"<nav><ul>{items}</ul></nav>", f"<ul>{items}</ul>", f"<div>{items.replace('li>', 'p>')}</div>"))


def _text(r: random.Random, y: str, rare: bool = True) -> str:
    """Paragraphs of any length; a short or linked one between others is text as well."""
    out, n = [], r.randint(3, 9)
    for i in range(n):
        words = r.choice((r.randint(1, 6), r.randint(12, 40), r.randint(25, 160), r.randint(25, 160)))
        inner = 0 < i < n - 1
        if not rare and (not inner or out[-1][1] < 12):
            words = max(words, 20)
        link = inner and out[-1][1] > 8 and words < 9 and r.random() < 0.3
        out.append((f"<p{y}>{{{words}@}}</p>" if link else f"<p{y}>{{{words}.}} {{{r.randint(1, 3)}@}}</p>" if words > 30 and r.random() < 0.3 else f"<p{y}>{{{words}.}}</p>", 20 if link else words))
    return "".join(x for x, _ in out)


def drawn() -> list[str]:
    """Skeletons drawn from kinds of pages, always the same ones."""
    r, out = random.Random(SEED), []

    def other() -> str:
        """Something that names announce, of up to 40 words."""
        tag, attr = r.choice((("aside", ""), ("div", " class=ad"), ("div", " class=share"), ("form", ""), ("div", " class=newsletter"), ("div", " id=related")))
        return f"<{tag}{attr} y=0>{{{r.randint(1, 40)}.}}</{tag}>"

    def named() -> str:
        return f"<div {r.choice(_BOILER)}>{{{r.randint(2, 60)}.}}</div>"

    def maybe(share: float, text: str) -> str:
        return text if r.random() < share else ""

    for _ in range(DRAWN):
        # an article element, whatever its blocks look like, with a list of links in some, and comments
        see = maybe(0.3, "<div y=0>" + "".join(f"<p>{{{r.randint(1, 4)}@}}</p>" for _ in range(r.randint(5, 9))) + "</div>")
        last = "" if see else maybe(0.4, f"<p>{{{r.randint(1, 6)}.}}</p>")
        text = maybe(0.9, f"<h1>{{{r.randint(1, 14)}}}</h1>") + maybe(0.2, f"<p>{{{r.randint(1, 9)}@}}</p>") + _text(r, "") + maybe(0.4, other() + _text(r, "")) + see + last
        text = r.choice((text, text, text, f"<h1>{{{r.randint(1, 14)}}}</h1>", f"<p>{{{r.randint(1, 90)}.}}</p>"))
        said = "".join(f"<article class=comment><p>{{{r.randint(1, 50)}.}}</p></article>" for _ in range(r.randint(1, 4)))
        article = r.choice((f"<article y=1>{text}</article>", f"<main y=1>{text}</main>", f"<main><article y=1>{text}</article></main>", f"<div {r.choice(('class=content', 'id=main-content', 'class=post-body', 'class=entry'))} y=1>{text}</div>"))
        article += maybe(0.3, f"<section id=comments><h2>{{{r.randint(1, 3)}}}</h2>{said}</section>")
        end = r.choice(("", named(), f"<footer>{{{r.randint(2, 40)}.}}</footer>", f"<div>{{{r.randint(2, 40)}.}}</div>", f"<div>{{{r.randint(1, 4)}@}}</div>", _menu(r)))
        start = r.choice((named(), named(), "", "", f"<div>{{{r.randint(2, 40)}.}}</div>"))
        out.append(maybe(0.6, _menu(r)) + start + article + end)
        # no hint, or one that misleads: long text between long text
        name = r.choice(("", "", "class=layout", "class=widget", "id=sidebar", "class=banner"))
        out.append(_menu(r) + f"<h1 y=1>{{{r.randint(2, 12)}}}</h1><div {name}>{_text(r, ' y=1', rare=False)}</div>" + r.choice((_menu(r), f"<p>{{{r.randint(1, 4)}}}</p>", f"<div>{{{r.randint(1, 4)}@}}</div>")))
        # names that announce something else, with too little text to be text
        out.append(_menu(r) + f"<div {r.choice(_BOILER)}>{{{r.randint(2, 16)}.}}</div>" + maybe(0.5, _menu(r)) + f"<p y=1>{{{r.randint(30, 90)}.}}</p><p y=1>{{{r.randint(20, 90)}.}}</p>" + r.choice((_menu(r), f"<div {r.choice(_BOILER)}>{{{r.randint(2, 16)}.}}</div>")))
        out.append(f"<p y=1>{{{r.randint(8, 120)}.}}</p>")
    return out


def pages() -> list[str]:
    """The labelled pages as HTML."""

    def fill(m: re.Match) -> str:
        n = int(m[1])
        words = " ".join(_FILL[i % len(_FILL)] for i in range(n))
        return f"<a href=#>{words}</a>" if m[2] == "@" else words + m[2]

    return ["<html><head><title>x</title></head><body>" + re.sub(r"\{(\d+)([@.]?)\}", fill, s) + "</body></html>" for s in (*SKELETONS, *drawn())]
