"""Pages of layouts that the extraction's own generator does not make, with their main texts."""

import random

VOWELS = "aeiou"


def _word(r: random.Random) -> str:
    return "".join(r.choice("bcdfghklmnprstvz") + r.choice(VOWELS) for _ in range(r.randint(1, 4)))


def _words(r, low, high) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high)))


def _sentences(r, low, high) -> str:
    return " ".join(f"{_words(r, 5, 15).capitalize()}{r.choice('.!?')}" for _ in range(r.randint(low, high)))


def _links(r, n, tag="span") -> str:
    return "".join(f'<{tag}><a href="/p{k}.html">{_words(r, 1, 3)}</a></{tag}>' for k in range(n))


def page(r: random.Random) -> tuple[str, str]:
    """Html and the main text's blocks, two line ends apart."""
    blocks, body = [], []
    title = _words(r, 3, 8).capitalize()
    blocks.append(title)
    body.append(f"<h2 class=headline>{title}</h2>")
    for _ in range(r.randint(2, 9)):
        kind = r.random()
        if kind < 0.65:
            text = _sentences(r, 2, 6)
            blocks.append(text)
            body.append(f"\n  <p class='para'>{text}</p>")
        elif kind < 0.75:
            lead, link, rest = _sentences(r, 1, 2), _words(r, 1, 2), _sentences(r, 1, 2)
            blocks.append(f"{lead} {link} {rest}")
            body.append(f"<p>{lead} <a href='https://example.org/{_word(r)}'><i>{link}</i></a>\n{rest}</p>")
        elif kind < 0.85:
            items = [_sentences(r, 1, 1) for _ in range(r.randint(2, 5))]
            blocks += items
            body.append("<ol>" + "".join(f"<li>{x}" for x in items) + "</ol>")
        elif kind < 0.92:
            quote = _sentences(r, 1, 3)
            blocks.append(quote)
            body.append(f"<blockquote>{quote}</blockquote>")
        else:
            body.append(f'<div class="promo-box ad"><a href="/buy">{_words(r, 2, 6)}</a></div>')
    holder = r.choice(("article", "main", "div"))
    name = r.choice((' class="post-body"', ' id="story"', ' class="entry"', "")) if holder == "div" else ""
    top = f'<div id="masthead" class="header"><div class="logo">{_words(r, 1, 2)}</div><div class="topnav menu">{_links(r, r.randint(3, 8))}</div></div>'
    crumbs = f'<div class="breadcrumb">{_links(r, 3)}</div>' if r.random() < 0.5 else ""
    side = f'<aside><h4>{_words(r, 1, 3)}</h4>{_links(r, r.randint(3, 9), "div")}</aside>' if r.random() < 0.6 else ""
    login = f'<form action="/in"><label>{_words(r, 1, 2)}</label><input name=q><button>{_words(r, 1, 1)}</button></form>' if r.random() < 0.4 else ""
    notice = f'<section class="cookie-bar notice"><p>{_sentences(r, 1, 2)}</p><button>OK</button></section>' if r.random() < 0.4 else ""
    said = "".join(f'<div class="comment reply"><cite>{_words(r, 1, 2)}</cite><p>{_sentences(r, 1, 3)}</p></div>' for _ in range(r.randint(1, 5)))
    comments = f'<div id="comments"><h3>{_words(r, 1, 2)}</h3>{said}</div>' if r.random() < 0.5 else ""
    foot = f'<footer><p>&copy; {_words(r, 2, 6)}</p>{_links(r, r.randint(2, 5))}</footer>'
    inner = f"<{holder}{name}>{''.join(body)}</{holder}>"
    layout = r.random()
    if layout < 0.4:
        middle = f'<div class="row"><div class="col">{crumbs}{inner}{comments}</div><div class="col narrow">{side}{login}</div></div>'
    elif layout < 0.7:
        middle = f"<section>{notice}{inner}</section>{side}{comments}"
    else:
        middle = f"{login}{crumbs}<div><div><div>{inner}</div></div></div>{comments}{side}"
    return f"<!doctype html>\n<html lang=en><head><meta charset=utf-8><title>{title}</title><style>a{{}}</style></head>\n<body>{top}{'' if layout < 0.7 and layout >= 0.4 else notice}{middle}{foot}<script>var x = '<p>no</p>';</script></body></html>", "\n\n".join(blocks)
