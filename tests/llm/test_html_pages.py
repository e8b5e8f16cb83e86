"""Hand-made pages with literal main texts, and what each feature of the path scores decides on them."""

from __future__ import annotations

import random

import numpy as np
import pytest

from eventloom.llm import html_extract

WORDS = "river stone market letter garden window morning captain village harbour engine paper winter bridge silver forest".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def para(rng, sentences=3, words=12):
    return " ".join(f"{sentence(rng, words)[:-1]}, {sentence(rng, words // 2).lower()}" for _ in range(sentences))


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


MENU = '<div><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sport</a></li></ul></div>'


def article_beside_discussion(rng):
    title, own, others = "A short notice", [para(rng, 1, 8) for _ in range(rng.choice([1, 2, 3]))], [para(rng, 4) for _ in range(8)]
    return f"<body>{MENU}<article><h1>{title}</h1>{p(*own)}</article><div class='talk'>{p(*others)}</div></body>", [title, *own]


def discussion_inside_the_article(rng):
    own, others = [para(rng) for _ in range(2)], [para(rng, 4) for _ in range(6)]
    name = rng.choice(["discussion", "opinions", "reader-replies", "user-feedback", "legal-disclaimer"])
    return f"<body><article><h1>Long talk</h1>{p(*own)}<div class='{name}'>{p(*others)}</div></article></body>", ["Long talk", *own]


def unnamed_comments(rng):
    own = [para(rng) for _ in range(3)]
    stamp = rng.choice(["12.03.2024", "3 hours", "#{}", "10:4{}"])
    each = "".join(f"<div class='x7'><span>{rng.choice(WORDS)} {stamp.format(i)}</span>{p(para(rng, 2), para(rng, 1))}</div>" for i in range(4))
    return f"<body><article><h1>No names</h1>{p(*own)}<div class='y9'>{each}</div></article></body>", ["No names", *own]


def comments_as_a_list(rng):
    own = [para(rng) for _ in range(3)]
    each = "".join(f"<li><a href='/u/{i}'>{rng.choice(WORDS)}</a><div>{para(rng, 3)}</div></li>" for i in range(5))
    return f"<body>{MENU}<div id='a1'><h1>Soup</h1><div>{p(*own)}</div></div><ol class='q'>{each}</ol></body>", ["Soup", *own]


def sections_are_no_comments(rng):
    parts = [(f"Part {i}", para(rng), para(rng)) for i in range(4)]
    body = "".join(f"<section class='part'><h2>{h}</h2>{p(a, b)}</section>" for h, a, b in parts)
    return f"<body><main><h1>Sections</h1>{body}</main><div class='sidebar'>{p(para(rng))}</div></body>", ["Sections", *[x for part in parts for x in part]]


def list_page(rng):
    items, block = [" ".join(rng.choice(WORDS) for _ in range(3)) for _ in range(20)], para(rng, 3, 10)
    return f"<body><div><h1>Things to see</h1><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul></div><div class='cookie-banner'><p>{block}</p></div></body>", ["Things to see", *items]


def two_articles(rng):
    own, other = [para(rng) for _ in range(3)], para(rng, 6)
    return f"<body><article class='teaser'><h2><a href='/t'>Elsewhere</a></h2><p>{other}</p></article><article><h1>The one</h1>{p(*own)}</article></body>", ["The one", *own]


def teaser_inside(rng):
    own, other = [para(rng) for _ in range(3)], para(rng, 2)
    return f"<body><article><h1>Holder</h1>{p(*own)}<article><h3><a href='/n'>Next story</a></h3><p>{other}</p></article></article></body>", ["Holder", *own]


def soup(rng):
    own = [para(rng) for _ in range(4)]
    return f"<body>{MENU}<div class='b1'><div><h1>Plain soup</h1></div><div>{p(*own)}</div></div><div class='b2'><span>Tel 12</span> <span>Fax 13</span></div></body>", ["Plain soup", *own]


def keywords_without_punctuation(rng):
    """A long part without punctuation: only the punctuation ratio tells it apart."""
    own, tags = [para(rng, 2, 9) for _ in range(3)], " ".join(rng.choice(WORDS) for _ in range(90))
    return f"<body><div class='k2'><h1>Keywords</h1>{p(*own)}</div><div class='k3'>{''.join(f'<div>{tags[i * 40 :]}</div>' for i in range(6))}</div></body>", ["Keywords", *own]


def marks_without_length(rng):
    """Many short texts full of marks: only the length ratio tells them apart."""
    own = [para(rng, 2, 9) for _ in range(3)]
    bits = "".join(f"<b>{i}.,</b><i>:;</i>" for i in range(30))
    return f"<body><div class='m1'><h1>Marks</h1>{p(*own)}</div><div class='m2'><div>{bits}</div></div></body>", ["Marks", *own]


def linked_stories(rng):
    """Other stories' leads as links: only the share outside links tells them apart."""
    own, leads = [para(rng, 2, 9) for _ in range(3)], [para(rng, 2) for _ in range(6)]
    return f"<body><div class='l1'><h1>Links</h1>{p(*own)}</div><div class='l2'>{''.join(f'<p><a href=/{i}>{t}</a></p>' for i, t in enumerate(leads))}</div></body>", ["Links", *own]


def lone_lead(rng):
    """A lead in a part of its own, long but without a mark: only smoothing gives it its neighbours' marks."""
    own, lead = [para(rng, 3) for _ in range(2)], " ".join(rng.choice(WORDS) for _ in range(60))
    return f"<body><div class='s1'><h1>Leads</h1></div><div class='s2'><em>{lead}</em></div><div class='s3'>{p(*own)}</div><div class='s4'>{''.join(f'<span>Imprint {i}</span> ' for i in range(8))}</div></body>", ["Leads", lead, *own]


KINDS = (article_beside_discussion, discussion_inside_the_article, unnamed_comments, comments_as_a_list, sections_are_no_comments, list_page, two_articles, teaser_inside, soup, keywords_without_punctuation, marks_without_length, linked_stories, lone_lead)
PAGES = [(kind, *kind(random.Random(f"{kind.__name__}{i}"))) for kind in KINDS for i in range(6)]


@pytest.mark.parametrize("kind", KINDS)
def test_hand_made_pages(kind):
    for _, html, want in (x for x in PAGES if x[0] is kind):
        assert html_extract.main_text(html) == "\n".join(want)


def changed(monkeypatch, scores):
    with monkeypatch.context() as m:
        m.setattr(html_extract, "path_scores", scores)
        return {kind.__name__ for kind, html, want in PAGES if html_extract.main_text(html) != "\n".join(want)}


def test_each_feature_of_the_scores_changes_texts(monkeypatch):
    """Without a feature, the pages that are made for it come out wrong."""
    real = html_extract.path_scores
    one = lambda x: np.ones_like(x)
    assert len(PAGES) >= 60 and not changed(monkeypatch, real)
    without = {
        "length": changed(monkeypatch, lambda of, length, marks, linked, noise: real(of, one(length) * 50, marks, linked, noise)),
        "punctuation": changed(monkeypatch, lambda of, length, marks, linked, noise: real(of, length, one(marks), linked, noise)),
        "links": changed(monkeypatch, lambda of, length, marks, linked, noise: real(of, length, marks, np.zeros_like(linked), noise)),
        "threshold": changed(monkeypatch, lambda of, length, marks, linked, noise: 1.0 + 0 * real(of, length, marks, linked, noise)),
    }
    with monkeypatch.context() as m:
        m.setattr(html_extract, "SMOOTH", np.array([0.0, 0.0, 1.0, 0.0, 0.0]))
        without["smoothing"] = changed(m, real)
    print({k: sorted(v) for k, v in without.items()})
    assert all(without.values()), without
