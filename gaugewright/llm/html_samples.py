"""Labelled pages for the HTML extractor: layouts drawn from a seed, every element marked as main text or not.

The attribute ``data-main`` holds the label. The words are invented; what the pages teach is structure: which elements, class names,
lengths, link shares and places go with main text, and how labels pass from parent to child. Three names in ten are invented
too, so that structure has to do where a name tells nothing.
"""

from __future__ import annotations

import random

# Class and id names as they are common on the web.
MAIN_NAMES = "content main article post entry story body text page-content post-content entry-content article-body story-body main-content post-body blog-post single"
MENU_NAMES = "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu site-nav toc pagination pager tabs skip-link"
HEADER_NAMES = "header masthead banner site-header top topbar page-header logo hero brand"
FOOTER_NAMES = "footer site-footer bottom colophon copyright legal page-footer credits"
SIDE_NAMES = "sidebar aside side rail widget widgets related recommended popular trending tags archive archives more-stories see-also"
NOTICE_NAMES = "notice cookie cookie-notice cookies consent gdpr alert warning message paywall popup modal overlay toast disclaimer announcement"
ADVERT_NAMES = "ad ads advert advertisement adsense sponsored sponsor promo promotion banner-ad ad-slot dfp outbrain taboola"
FORM_NAMES = "form search search-form login newsletter subscribe signup contact-form subscription"
COMMENT_NAMES = "comments comment comment-list commentlist disqus replies reply respond discussion reader-comments thread"
SHARE_NAMES = "share social social-share sharing follow byline-links print tools"
PLAIN_NAMES = "container wrapper row col inner outer wrap grid section block box"
SYLLABLES = "ba ren tol mi sa ker vo lin da mer pu sti an ge lor fi"

_WORDS = SYLLABLES.split()


class _Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(_WORDS) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(7, len(out), 8):
            out[i] += r.choice(",.")
        return " ".join(out).capitalize() + r.choice(("", ".", "."))

    def named(self, names: str, chance: float = 0.9) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice(names.split()) if r.random() > 0.3 else "".join(r.choice(_WORDS) for _ in range(3))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def el(self, tag: str, y: int, inner: str, attrs: str = "") -> str:
        return f'<{tag}{attrs} data-main="{y}">{inner}</{tag}>'

    def links(self, y: int = 0) -> str:
        items = "".join(self.el("li", y, f'<a href="/x">{self.words(1, 3)}</a>') for _ in range(self.r.randint(2, 8)))
        return self.el("ul", y, items)

    def para(self, y: int, short: bool = False) -> str:
        r = self.r
        low, high = r.choice(((1, 4), (4, 15), (15, 60), (60, 200))) if not short else r.choice(((1, 6), (5, 25)))
        text = self.words(low, high)
        if r.random() < 0.15:
            text = f"<b>{text}</b> " + self.words(2, 8)
        if r.random() < 0.1:
            text += f' <a href="/y">{self.words(1, 3)}</a>'
        return self.el("p", y, text)

    def side(self, tags: str, names: str, chance: float = 0.9) -> str:
        r = self.r
        body = r.choice((self.links, lambda: self.para(0, True), lambda: self.words(2, 14), lambda: self.el("h3", 0, self.words(1, 3)) + self.links(), lambda: self.el("div", 0, self.words(3, 20)), lambda: self.el("p", 0, self.words(30, 200))))()
        return self.el(r.choice(tags.split()), 0, body, self.named(names, chance))

    def comments(self) -> str:
        """Readers' comments: a heading, then two or more of the same make, with or without names."""
        r = self.r
        tag = r.choice(("li", "div", "li", "div", "li", "div", "article"))
        names = r.random() < 0.6
        head = r.choice((lambda: "", lambda: f"<b>{self.words(1, 2)}</b> <time>{self.words(1, 2)}</time>", lambda: self.el("div", 0, self.words(1, 3)), lambda: f"<cite>{self.words(1, 2)}</cite>"))
        longest = r.choice((12, 20, 60, 200))

        def one(replies: bool = True) -> str:
            text = self.words(3, longest)
            body = head() + (self.el("p", 0, text) if r.random() < 0.75 or tag != "li" else text)
            if replies and r.random() < 0.15:
                answers = "".join(one(False) for _ in range(r.randint(1, 2)))
                body += self.el(r.choice(("ul", "ol")), 0, answers) if tag == "li" else answers
            return self.el(tag, 0, body, self.named(COMMENT_NAMES, 0.8) if names else "")

        each = "".join(one() for _ in range(r.randint(1, 6)))
        if tag == "li" and r.random() < 0.6:
            each = self.el(r.choice(("ul", "ol")), 0, each)
        title = self.el(r.choice(("h2", "h3", "h4")), 0, self.words(1, 5)) if r.random() < 0.8 else ""
        if r.random() < 0.2:
            each += self.el("form", 0, self.words(1, 4))
        return self.el(r.choice(("section", "div", "div")), 0, title + each, self.named(COMMENT_NAMES, 1 if names else 0.3))

    def extras(self) -> str:
        r = self.r
        return r.choice(
            (
                lambda: self.side("nav", MENU_NAMES, 0.4),
                lambda: self.side("div ul", MENU_NAMES, 1),
                lambda: self.side("header", HEADER_NAMES, 0.5),
                lambda: self.side("div", HEADER_NAMES, 1),
                lambda: self.side("footer", FOOTER_NAMES, 0.4),
                lambda: self.side("div", FOOTER_NAMES, 1),
                lambda: self.side("aside", SIDE_NAMES, 0.5),
                lambda: self.side("div section", SIDE_NAMES, 1),
                lambda: self.side("div section p", NOTICE_NAMES, 1),
                lambda: self.side("div section", ADVERT_NAMES, 1),
                lambda: self.side("form", FORM_NAMES, 0.5),
                lambda: self.side("div", FORM_NAMES, 1),
                lambda: self.side("div ul", SHARE_NAMES, 1),
                self.comments,
            )
        )()

    def block(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.72:
            return self.para(1)
        if x < 0.80:
            return self.el(r.choice(("h2", "h3")), 1, self.words(1, 8))
        if x < 0.86:
            tag = r.choice(("ul", "ol"))
            return self.el(tag, 1, "".join(self.el("li", 1, self.words(2, 25)) for _ in range(r.randint(1, 6))))
        if x < 0.90:
            return self.el("blockquote", 1, self.para(1))
        if x < 0.92:
            return self.el("pre", 1, self.words(4, 40))
        if x < 0.94:
            return self.el("table", 1, "".join(self.el("tr", 1, "".join(self.el("td", 1, self.words(1, 4)) for _ in range(3))) for _ in range(3)))
        head = self.el(r.choice(("h2", "h3")), 1, self.words(1, 8)) if r.random() < 0.5 else ""
        body = "".join(self.para(1) if r.random() < 0.8 else self.el("ul", 1, "".join(self.el("li", 1, self.words(2, 25)) for _ in range(r.randint(2, 5)))) for _ in range(r.randint(1, 4)))
        return self.el(r.choice(("div", "section")), 1, head + body, self.named(PLAIN_NAMES, 0.3))

    def main(self) -> str:
        r = self.r
        inner = self.el("h1", 1, self.words(2, 12)) if r.random() < 0.8 else ""
        if inner and r.random() < 0.15:
            inner = self.el("header", 1, inner)
        brief = r.random() < 0.3  # some articles are a few words
        longest = r.choice((2, 4, 8))
        for _ in range(r.randint(1, 9)):
            inner += self.el("p", 1, self.words(1, longest)) if brief else self.block()
            if r.random() < 0.12:
                inner += self.extras()
        if r.random() < 0.12:
            inner += self.comments()
        elif r.random() < 0.1:
            inner += self.side("div section p", NOTICE_NAMES, 1)
        kind = r.random()
        if kind < 0.08:
            return inner
        if kind < 0.55:
            return self.el("article", 1, inner, self.named(MAIN_NAMES, 0.3))
        if kind < 0.7:
            return self.el("main", 1, inner, self.named(MAIN_NAMES, 0.3))
        return self.el(r.choice(("div", "div", "section")), 1, inner, self.named(MAIN_NAMES, 0.7))

    def page(self) -> str:
        r = self.r
        before = "".join(self.extras() for _ in range(r.randint(0, 4)))
        after = "".join(self.extras() for _ in range(r.randint(0, 4)))
        body = self.main()
        bare = body.startswith(("<h1", "<p", "<h2", "<h3", "<ul", "<ol", "<bl", "<pre", "<ta"))
        if bare:
            before, after = before if r.random() < 0.5 else "", after if r.random() < 0.5 else ""
        elif r.random() < 0.3:
            body = self.el(r.choice(("div", "main", "section")), 0, body + (self.extras() if r.random() < 0.6 else ""), self.named(PLAIN_NAMES, 0.8))
        return f'<html data-main="0"><body data-main="{int(bare)}">{before}{body}{after}</body></html>'


def labelled_pages(n: int = 2000, seed: int = 11) -> list[str]:
    pages = _Pages(seed)
    return [pages.page() for _ in range(n)]
