"""Pages that the trees have not seen, of varied layouts, with their main text; and what marks alone can't do."""

import pytest

from polysema.llm import html

A, B, C = "The river rose for three days and the bridge was closed to all traffic.", "Engineers say that the old stones will hold until the water falls again.", "A decision is expected on Monday."
LINKS = "".join(f'<li><a href="/{k}">Topic {k}</a></li>' for k in range(6))

PAGES = {
    "related work": (f"<main><h1>Bridges</h1><p>{A}</p><section id='related-work'><h2>Related work</h2><p>{B}</p></section></main>", f"Bridges {A} Related work {B}"),
    "form guide": (f"<article><p>{A}</p><div class='form-guide'><p>{B}</p></div></article>", f"{A} {B}"),
    "share price": (f"<article><p>{A}</p><p class='share-price'>{C}</p><p>{B}</p></article>", f"{A} {C} {B}"),
    "notice period": (f"<article><p>{A}</p><section id='notice-period'><p>{B}</p></section></article>", f"{A} {B}"),
    "comment policy": (f"<main><p>{A}</p><div class='comment-policy'><p>{B} {C}</p></div></main>", f"{A} {B} {C}"),
    "related posts": (f"<article><p>{A}</p><p>{B}</p><div class='related-posts'><ul>{LINKS}</ul></div></article>", f"{A} {B}"),
    "comments": (f"<article><p>{A}</p><p>{B}</p></article><section id='comments'><p>{B} I think so too, and so does my whole street.</p></section>", f"{A} {B}"),
    "menu and footer": (f"<nav><ul>{LINKS}</ul></nav><article><h2>News</h2><p>{A}</p></article><footer>All rights reserved</footer>", f"News {A}"),
    "no area": (f"<div class='navbar'><a>Home</a> <a>About</a></div><h1>Flood</h1><p>{A}</p><p>{B}</p><div class='footer-links'><a>Terms</a> <a>Jobs</a></div>", f"Flood {A} {B}"),
    "half marked links": (f"<article><p>{A}</p><p>{B}</p><div class='related-reading-tips'><a href=1>Ten tips</a> <a href=2>Nine rules</a></div></article>", f"{A} {B}"),
    "half marked outside": (f"<article><p>{A}</p></article><div class='newsletter-offer'><p>Get our weekly letter with all the stories of the week for free.</p></div>", A),
    "advert": (f"<main><p>{A}</p><div class='ad-slot'><p>Cheap boats, only today, buy two and pay one.</p></div><p>{B}</p></main>", f"{A} {B}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert html.main_text(page) == want


def test_f1_over_all_pages():
    right = found = there = 0
    for page, want in PAGES.values():
        got, want = html.main_text(page).split(), want.split()
        right += sum(min(got.count(w), want.count(w)) for w in set(want))
        found += len(got)
        there += len(want)
    assert 2 * right / (found + there) > 0.99


def test_trees_overrule_half_marks_and_areas():
    """Blocks that a rule by marks and areas alone would get wrong."""
    overruled = 0
    for page, _ in PAGES.values():
        blocks = html.blocks(page)
        area = any(b.main and b.mark < 1 for b in blocks)
        kept = html.main_text(page)
        overruled += sum((b.mark == 0 and (b.main or not area)) != (b.text in kept) for b in blocks)
    assert overruled >= 6


@pytest.mark.parametrize("name,mark", [("comment-list", 1), ("related-posts", 1), ("ad-slot", 1), ("siteFooter", 1), ("related-work", 0.5), ("share-price", 0.5), ("has-sidebar", 0), ("adaptive", 0), ("story", 0)])
def test_marks(name, mark):
    assert html.mark_of("div", f' class="{name}"') == mark == html.mark_of("div", f" id={name}")
