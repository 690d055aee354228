"""Pages composed by rule, with the texts of their articles: what the block labeller is trained on."""

from __future__ import annotations

import re
from random import Random

_SYLLABLES = "an ar ba be ca ce co da de di el en er es fa ga ha he in is ka la le li lo ma me mi na ne no on or pa pe po ra re ri ro sa se si so ta te ti to un ur va ve vi zu th sh ch ing tion ment eau qu ung keit lich rr ñ é è ö ü ción".split()
_COMMON = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so la le les de des et un une que qui dans pour est sur der die das und ein nicht mit von zu el los las con por para".split()
_MENU = "home about contact news sports login register search archive help services products blog shop account subscribe privacy terms sitemap more next previous share tweet print login menu top".split()


def _word(r: Random) -> str:
    if r.random() < 0.35:
        return r.choice(_COMMON)
    return "".join(r.choices(_SYLLABLES, k=r.randrange(1, 5)))


def _sentence(r: Random, n: int | None = None) -> str:
    words = [_word(r) for _ in range(n or r.randrange(1, 22))]
    if r.random() < 0.08:
        words = [w + r.choice(["***", "%%%", "!!", " |", "$$$"]) for w in words]
    if r.random() < 0.06:
        words = [w.upper() for w in words]
    if r.random() < 0.06:
        words = [w + " |" for w in words]
    return " ".join(words).capitalize() + r.choices([".", "!", "?", ""], [0.9, 0.04, 0.04, 0.02])[0]


def _text(r: Random, most: int = 8) -> str:
    return " ".join(_sentence(r) for _ in range(r.randrange(1, most + 1)))


def _pick(r: Random, *some: str) -> str:
    return r.choice(some)


def _menu(r: Random) -> str:
    items = [r.choice(_MENU) if r.random() < 0.5 else _word(r) + r.choices(["", ",", ".", "!"], [0.6, 0.15, 0.2, 0.05])[0] for _ in range(r.randrange(2, 9))]
    if r.random() < 0.75:
        inner = "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in items) + "</ul>"
    else:
        inner = _pick(r, " ", " | ", " &middot; ").join(f'<a href="/{x}">{x}</a>' for x in items)
    tag = _pick(r, "nav", "nav", 'div class="menu"', 'div id="navbar"', 'div class="nav-bar top"', 'ul class="breadcrumbs"', 'div class="breadcrumb"', 'div role="navigation"')
    return f"<{tag}>{inner}</{tag.split()[0]}>"


def _boxed(r: Random, tags: list[str], inner: str) -> str:
    tag = r.choice(tags)
    return f"<{tag}>{inner}</{tag.split()[0]}>"


def _lines(r: Random, most: int = 3) -> str:
    n = r.randrange(1, most + 1)
    if n == 1 and r.random() < 0.6:
        return _text(r, 3)
    return "".join(f"<p>{_text(r, 3)}</p>" for _ in range(n))


def _header(r: Random) -> str:
    inner = _pick(r, f"<h1>{_sentence(r, 3)}</h1>", f'<div class="logo">{_word(r)}</div>', f"<p>{_sentence(r)}</p>", f"<a href='/'>{_word(r)}</a>")
    return _boxed(r, ["header", "header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'div class="banner"', 'div role="banner"'], inner + (_menu(r) if r.random() < 0.4 else ""))


def _ad(r: Random) -> str:
    return _boxed(r, ['div class="ad"', 'div class="ad"', 'div class="advert"', 'div class="ads banner"', 'div id="sponsored"', 'aside class="ad"', 'div class="promo"', 'section class="advertisement"', 'div class="ad-slot"', 'p class="ad"'], _lines(r, 2) if r.random() < 0.7 else _text(r, 2))


def _notice(r: Random) -> str:
    return _boxed(r, ['div class="notice"', 'div class="cookie-notice"', 'div id="cookie-banner"', 'div class="alert"', 'div role="alert"', 'p class="notice"', 'div class="consent"', 'div class="newsletter"', 'aside class="notice"', 'div class="popup"', 'div class="warning"', 'div class="paywall"'], _lines(r, 2) if r.random() < 0.6 else _text(r, 2))


def _sidebar(r: Random) -> str:
    inner = f"<h{3}>{_sentence(r, 2)}</h3>" if r.random() < 0.6 else ""
    if r.random() < 0.5:
        inner += "<ul>" + "".join(f'<li><a href="#">{_sentence(r, r.randrange(1, 8))}</a></li>' for _ in range(r.randrange(2, 7))) + "</ul>"
    else:
        inner += _lines(r, 3)
    return _boxed(r, ["aside", "aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'aside class="related"', 'div class="related-posts"', 'section class="recommended"', 'div id="right-column" class="side"', 'div role="complementary"'], inner)


def _form(r: Random) -> str:
    inner = f"<label>{_sentence(r, 2)}</label><input name=q>" + _pick(r, f"<p>{_sentence(r)}</p>", f"<div>{_sentence(r, 3)}</div>", "", f"<select><option>{_word(r)}</option><option>{_word(r)}</option></select>") + f"<button>{_word(r)}</button>"
    return _boxed(r, ["form", 'form class="search"', 'div class="form"><form', 'form id="signup"', 'form class="comment-form"'], inner) if r.random() < 0.9 else f"<form action='/s'>{inner}</form>"


def _comments(r: Random) -> str:
    def one() -> str:
        who = f"{_word(r)}{r.randrange(1, 99)}"
        return _boxed(r, ["li", "div class='comment'", "div class='comment-body'", "article class='comment'", "p"], _pick(r, f"<b>{who}</b> ", f"<p class='author'>{who}</p>", f"<cite>{who}</cite>: ", "") + _lines(r, 2) + _pick(r, "", "<a href='#'>Reply</a>"))

    head = _pick(r, f"<h2>{_sentence(r, 1)}</h2>", f"<h3>Comments ({r.randrange(1, 40)})</h3>", "")
    return _boxed(r, ['section class="comments"', 'div id="comments"', 'div class="comments"', 'ol class="comment-list"', 'section id="disqus" class="responses"', 'div class="user-comments"', 'ul class="comments"', 'div class="reader-comments"'], head + "".join(one() for _ in range(r.randrange(1, 7))))


def _footer(r: Random) -> str:
    inner = _pick(r, "&copy; ", "&#169; 2020 ", "", "Copyright ") + f"{_word(r)}.example.com" + _pick(r, " &middot; ", " | ", " - ") + _text(r, 2)
    if r.random() < 0.4:
        inner = f"<p>{inner}</p>" + _menu(r)
    return _boxed(r, ["footer", "footer", "footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer legal"', 'div role="contentinfo"'], inner)


def _links(r: Random) -> str:
    """Links to other pages, in a block without a name."""
    items = [f'<a href="/{i}">{_sentence(r, r.randrange(1, 5)).rstrip(".!?")}</a>' for i in range(r.randrange(2, 6))]
    head = f"<h{r.randrange(2, 6)}>{_sentence(r, r.randrange(1, 5)).rstrip('.!?')}</h{r.randrange(2, 6)}>" if r.random() < 0.6 else ""
    return f"<div>{head}{_pick(r, '<br>', ' ', ' | ', '</div><div>').join(items)}</div>"


def _colophon(r: Random) -> str:
    """A last line with a link and little else."""
    inner = _pick(r, "&copy; ", "", "Copyright ", "&#169; 2014 ") + _sentence(r, r.randrange(2, 9)) + f' <a href="mailto:x">{_sentence(r, r.randrange(1, 4)).rstrip(".!?")}</a>' + _pick(r, "", ".", " | " + f'<a href="/l">{_word(r)}</a>')
    return _pick(r, f"<div>{inner}</div>", f"<p><small>{inner}</small></p>", f"<td align=center>{inner}</td>")


_NAMED = re.compile(r"<(/?)(?:nav|header|footer|aside|article|main|section)\b[^>]*>")
_NAMES = re.compile(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")


def _unnamed(r: Random, page: str) -> str:
    """The page with tags that tell nothing."""
    tag = _pick(r, "div", "div", "td", "span></span><div")
    page = _NAMED.sub(lambda m: f"</{tag.split('<')[-1]}>" if m[1] else f"<{tag}>", page)
    return _NAMES.sub(lambda _: _pick(r, "", f' class="{r.choice("abcdefg")}{r.randrange(9)}"'), page)


#: Ends every text of the article; a private-use character that is taken out again before anything is learnt.
MARK = "\ue000"
#: Share of pages whose tags tell nothing.
UNNAMED = 0.2


def composed(r: Random) -> str:
    """A page whose article texts bear MARK."""

    def own(text: str) -> str:
        return text + MARK

    body: list[str] = []
    plain = r.random() < UNNAMED
    if r.random() < 0.9:
        level = _pick(r, "1", "1", "2")
        body.append(f"<h{level}>{own(_sentence(r, r.randrange(2, 12)))}</h{level}>")
    inner_parts = [_ad, _notice, _sidebar, _form]
    for _ in range(r.randrange(1, 16)):
        kind = r.random()
        if kind < 0.68:
            body.append(f"<p>{own(_text(r))}</p>" if r.random() < 0.85 else f"<p><b>{own(_text(r, 3))}<br>")
        elif kind < 0.78:
            body.append(f"<h2>{own(_sentence(r, r.randrange(1, 7)))}</h2>")
        elif kind < 0.84:
            body.append("<ul>" + "".join(f"<li>{own(_sentence(r))}</li>" for _ in range(r.randrange(2, 6))) + "</ul>")
        elif kind < 0.88:
            body.append(f"<blockquote>{own(_text(r, 3))}</blockquote>")
        elif kind < 0.90:
            body.append("<table>" + "".join(f"<tr><td>{own(_word(r))}</td><td>{own(_sentence(r, 3))}</td></tr>" for _ in range(r.randrange(1, 4))) + "</table>")
        elif kind < 0.95:
            body.append(f"<div>{own(_text(r))}</div>")
        elif not plain:
            body.append(inner_parts[r.randrange(len(inner_parts))](r))
    if MARK not in "".join(body):
        body.append(f"<p>{own(_text(r))}</p>")
    if r.random() < 0.15 and body[0].startswith("<h"):
        body[0] = f"<header>{body[0]}</header>"
    if r.random() < 0.15:
        at = r.randrange(len(body))
        body = [*body[:at], "<section>", *body[at:], "</section>"]
    tag = _pick(r, "article", "article", "article", "main", 'div class="content"', 'div class="post"', 'div id="article-body"', 'div class="entry-content"', 'section class="story"', "div", 'main><article class="post"', 'div role="main"')
    shut = tag.split(">")[-1].lstrip("<").split()[0]
    core = f"<{tag}>" + "".join(body) + ("" if r.random() < 0.05 else f"</{shut}>")
    before = [f(r) for f, p in ((_notice, 0.2), (_header, 0.4), (_menu, 0.8), (_ad, 0.5), (_form, 0.15), (_sidebar, 0.2)) if r.random() < p]
    after = [f(r) for f, p in ((_ad, 0.3), (_sidebar, 0.35), (_comments, 0.45), (_form, 0.15), (_notice, 0.15), (_footer, 0.85)) if r.random() < p]
    if r.random() < 0.3:
        r.shuffle(before)
    if r.random() < 0.2:
        before, after = ["<div class='wrapper'>", *before], [*after, "</div>"]
    if plain:  # without names, only what its links and its place tell apart is put around the article
        before = [f(r) for f, p in ((_links, 0.3), (_menu, 0.9)) if r.random() < p]
        after = [f(r) for f, p in ((_links, 0.4), (_colophon, 0.5), (_footer, 0.5)) if r.random() < p]
    head = f"<!DOCTYPE html><html><head><title>{_sentence(r)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    page = "".join(before) + core + "".join(after)
    return head + (_unnamed(r, page) if plain else page) + ("</body></html>" if r.random() < 0.9 else "")
