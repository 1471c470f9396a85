"""Made-up pages with labelled blocks, to train the block labeller.

Words are made from random syllables, so what is learned about words is little and about
structure much: article and other parts share their vocabulary, as they do on real pages.
"""

from __future__ import annotations

import random

#: Names of elements by the part of the page they hold, in the forms that sites use.
ROLES = {
    "menu": (["nav", "div", "ul", "header"], ["nav", "menu", "navbar", "navigation", "main-menu", "top-nav", "breadcrumb", "breadcrumbs", "site-nav", "tabs", "pagination", "toc", "links"]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "topbar", "page-header", "branding", "logo", "tagline"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", "colophon", "bottom", "legal", "page-footer"]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "right-col", "trending", "popular", "recent-posts", "more-stories", "recommended", "tags", "author-box", "read-more"]),
    "notice": (["div", "section", "p", "dialog"], ["cookie", "cookie-banner", "consent", "notice", "alert", "gdpr", "banner", "popup", "modal", "disclaimer", "paywall", "message", "warning", "announcement"]),
    "advert": (["div", "aside", "section", "p"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "adsbox", "promotion", "sponsor", "commercial"]),
    "form": (["form"], ["search", "login", "newsletter", "signup", "subscribe", "contact", "search-form", ""]),
    "share": (["div", "ul", "section"], ["share", "social", "share-buttons", "sharing", "follow", "buttons", "toolbar", "print"]),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment-list", "commentlist", "responses", "discussion", "disqus", "reader-comments", "replies", "comment-thread"]),
}
MAIN = (["article", "main", "div", "section", "td"], ["content", "article", "post", "entry", "article-body", "story", "main", "entry-content", "post-content", "text", "body", "page-content", ""])
BOXES, COMMENT = ("inner", "wrap", "container", "row", "box", "col"), ("comment", "reply", "comment-body", "response")
#: Parts of the names that sites use; others tell nothing.
KNOWN = frozenset(part for names in (*(own for _, own in ROLES.values()), MAIN[1], BOXES, COMMENT, ("author",)) for name in names for part in name.split("-") if part)
INNER = ["div", "section", "div", "span"]
SOUNDS = "th er an re he in on at nd st es en of te ed or ti hi as to ou ch ei un ie ver be sch ge ich que le ai oi ment tion eau ado ción os as ar ue la mi na ka ro shi tu po vel ü é ñ ä".split()
SAYINGS = {
    "menu": "home about contact news sports products services login blog archive help".split(),
    "header": "welcome home login search".split(),
    "footer": "copyright © all rights reserved privacy policy terms of use contact imprint impressum".split(),
    "sidebar": "related popular read more latest recommended about the author tags".split(),
    "notice": "we use cookies accept this site consent privacy please enable javascript subscribe to continue".split(),
    "advert": "sponsored advertisement buy now sale offer shop free discount".split(),
    "form": "search email name password submit send subscribe your message".split(),
    "share": "share tweet facebook print email like".split(),
    "comments": "reply says comment posted ago report like thanks".split(),
}


class Maker:
    """One page from one seed: ``html`` and, for each leaf block in order, whether it is of the article."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice(SOUNDS) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4)))) for _ in range(120)]
        self.labels: list[int] = []
        # names as sites use them, names that say nothing, or none; tags that say something, or none that do
        self.naming = self.r.choice(("site", "site", "made", "made", "none"))
        self.tags = self.r.choice(("semantic", "semantic", "some", "neutral"))
        r = self.r
        before = [k for k in ("menu", "header", "notice", "advert", "form", "menu", "share") if r.random() < 0.45]
        after = [k for k in ("advert", "share", "comments", "sidebar", "form", "sidebar", "notice", "menu") if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        out = [self.part(k) for k in before]
        if r.random() < 0.2:
            out.append(self.part("sidebar"))
        out.append(self.article())
        out += [self.part(k) for k in after]
        if r.random() < 0.85:
            out.append(self.part("footer"))
        self.html = "<html><head><title>x</title></head><body>" + "".join(out) + "</body></html>"

    def say(self, low: int, high: int, role: str = "") -> str:
        own = [self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        if role and self.r.random() < 0.4:
            own = [self.r.choice(SAYINGS[role]) if self.r.random() < 0.5 else w for w in own]
        return " ".join(own).capitalize() + self.r.choice((".", ".", "", "!"))

    def leaf(self, tag: str, text: str, main: int, name: str = "") -> str:
        self.labels.append(main)
        if self.r.random() < 0.1:
            text = f"<b>{text}</b>"
        return f"<{tag}{name}>{text}</{tag}>"

    def attribute(self, *own: str, odd: float = 0.2) -> str:
        """A class or id with one of some names, in the page's way of naming; ``odd`` tells how often it says nothing all the same."""
        name = self.r.choice(own)
        if not name or self.naming == "none":
            return ""
        if self.naming == "made" or self.r.random() < odd:
            name = "-".join(self.r.choice(self.words) for _ in range(self.r.choice((1, 1, 2))))
        return f' {self.r.choice(("class", "class", "class", "id"))}="{name}"'

    def opened(self, tags: list[str], own: list[str], odd: float = 0.2) -> tuple[str, str]:
        if (self.tags != "semantic" or self.r.random() < odd) and len(tags) > 1:
            plain = ("div",) if self.tags != "some" else ("div", "p", "ul", "section", "td", "form", "ol")
            tags = [t for t in tags if t in plain] or ["div"]
        tag = self.r.choice(tags)
        usual = 0.6 if tag in ("nav", "header", "footer", "article", "main", "aside", "form") else 0.95
        return tag, self.attribute(*own, odd=odd) if self.r.random() < usual else ""

    def wrapped(self, tag: str, name: str, inside: str) -> str:
        if self.r.random() < 0.3 and tag != "p":
            inner = self.r.choice(INNER)
            inside = f'<{inner}{self.attribute(*BOXES)}>{inside}</{inner}>'
        return f"<{tag}{name}>{inside}</{tag}>"

    def part(self, role: str) -> str:
        r = self.r
        tag, name = self.opened(*ROLES[role])
        if tag == "p":
            return self.leaf(tag, self.say(2, 30, role), 0, name)
        out = []
        if role in ("menu", "share") or role in ("footer", "sidebar", "header") and r.random() < 0.4:
            n = r.randint(2, 8)
            if role == "sidebar" and r.random() < 0.7:
                out.append(self.leaf(r.choice(("h3", "h4", "h2")), self.say(1, 3, role), 0))
            for _ in range(n):
                out.append(self.leaf("li", f'<a href="/">{self.say(1, 6 if role == "sidebar" else 3, role)}</a>', 0))
            out = [*out[:-n], "<ul>" if tag not in ("ul", "ol") else "", *out[-n:], "</ul>" if tag not in ("ul", "ol") else ""]
        elif role == "form":
            for _ in range(r.randint(1, 4)):
                out.append(self.leaf(r.choice(("label", "p", "label", "div")), self.say(1, 6, role), 0) + "<input type=text>")
            if r.random() < 0.7:
                out.append(self.leaf("button", self.say(1, 2, role), 0))
        elif role == "comments":
            if r.random() < 0.6:
                out.append(self.leaf(r.choice(("h2", "h3", "h4")), self.say(1, 3, role), 0))
            for _ in range(r.randint(1, 6)):
                inner = self.leaf("p", self.say(3, 50, role), 0)
                if r.random() < 0.5:
                    inner = self.leaf("div", self.say(1, 4, role), 0, self.attribute("author")) + inner
                box = "li" if tag in ("ol", "ul") else "div"
                out.append(f'<{box}{self.attribute(*COMMENT)}>{inner}</{box}>')
        else:
            for _ in range(r.choice((1, 1, 1, 2, 3))):
                t = r.choice(("p", "p", "div", "h3", "h4", "bare"))
                link = r.random() < 0.3
                text = self.say(1, 40 if role in ("advert", "notice", "footer") else 12, role)
                text = f'<a href="/x">{text}</a>' if link else text
                if t == "bare":
                    if not out:
                        self.labels.append(0)
                        out.append(("&copy; " if role == "footer" and r.random() < 0.6 else "") + text)
                else:
                    out.append(self.leaf(t, text, 0))
        return self.wrapped(tag, name, "".join(out))

    def article(self) -> str:
        r = self.r
        tag, name = self.opened(*MAIN, odd=0.45)
        out = []
        if r.random() < 0.85:
            out.append(self.leaf(r.choice(("h1", "h1", "h2")), self.say(2, 12), 1))
        for _ in range(r.choice((1, 2, 3, 4, 6, 9, 14, 20, 30))):
            x = r.random()
            if x < 0.74:
                out.append(self.leaf("p", self.say(1, 80) if r.random() < 0.65 else self.say(1, 3), 1))
            elif x < 0.79:
                self.labels.append(1)
                out.append(f"<p><b>{self.say(1, 12)}<br>")
            elif x < 0.84:
                out.append(self.leaf(r.choice(("h2", "h3")), self.say(1, 7), 1))
            elif x < 0.88:
                out.append("<ul>" + "".join(self.leaf("li", self.say(1, 20), 1) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.90:
                out.append(self.leaf("blockquote", self.say(4, 30), 1))
            elif x < 0.92:
                out.append(self.leaf("pre", self.say(3, 20), 1))
            else:
                out.append(self.part(r.choice(("advert", "share", "sidebar", "notice", "advert", "form"))))
        if r.random() < 0.12:
            out.append(self.part("comments"))
        return self.wrapped(tag, name, "".join(out))
