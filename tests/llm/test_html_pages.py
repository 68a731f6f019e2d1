"""Pages written by hand in layouts of their own, decoding against all choices, and large pages in bounded memory."""

import itertools
import random

import numpy as np
import psutil
import pyarrow.parquet as pq
import pytest

from doclake.llm import html_extract as H

P = [
    "The ferry left the harbour at seven, with forty passengers and a cargo of timber, and nobody expected the storm that came after noon.",
    "By the time the lighthouse was seen again, two of the masts had gone; the crew, tired and cold, had thrown half of the timber overboard.",
    "Most of what we know comes from the log of the second officer, who wrote a line every hour, even when the ink was close to freezing.",
    "Bread made with rye keeps longer than bread made with wheat, because its starch holds water better, and the crumb dries slowly.",
    "Mix the flour with warm water and the sour starter, cover the bowl, and leave it in a warm place until the next morning.",
    "Bake it hot for a quarter of an hour, then lower the heat; the loaf is done when it sounds hollow, which takes about an hour more.",
    "The committee met four times during the spring, and heard from teachers, parents and bus drivers about the length of the school day.",
    "Its report, published on Monday, asks for later starts in winter, shorter breaks, and a second look at how children get home.",
    "Whether the town can pay for it is another question, as the treasurer pointed out, since every extra bus costs more than a classroom.",
]
A, B, C = "|".join(P[:3]), "|".join(P[3:6]), "|".join(P[6:])
p = lambda *which: "".join(f"<p>{P[i]}</p>" for i in which)
li = lambda *words: "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words)
MENU = f"<ul>{li('Home', 'News', 'Sport', 'Culture', 'About')}</ul>"

#: Pages, and their main text block by block.
PAGES = [
    (f"<html><body><nav>{MENU}</nav><article><h1>The ferry</h1>{p(0, 1, 2)}</article><footer>© 2024 Harbour News</footer></body></html>", "The ferry|" + A),
    (f"<body><header><a href=/>Harbour News</a></header><main><h1>Rye bread</h1>{p(3, 4, 5)}</main><aside><h3>More recipes</h3><ul>{li('Pies', 'Soups', 'Cakes')}</ul></aside></body>", "Rye bread|" + B),
    (f"<div class=topbar><a href=/>Town</a></div><div class=content><h1>School day</h1>{p(6, 7, 8)}</div><div class=footer><p>All rights reserved.</p></div>", "School day|" + C),
    (f"<div id=wrap><div class=menu>{MENU}</div><div class=story><h2>The storm</h2>{p(0, 1)}<blockquote><p>{P[2]}</p></blockquote></div></div>", "The storm|" + A),
    (f"<body><div class=cookie-notice><p>We use cookies to make this site work. <a href=/c>Accept</a></p></div><article><h1>Loaf</h1>{p(3)}<h2>Method</h2>{p(4, 5)}</article></body>", f"Loaf|{P[3]}|Method|{P[4]}|{P[5]}"),
    (f"<article><h1>Report</h1>{p(6)}<div class=advert><p>Buy the new phone today and save a lot.</p></div>{p(7, 8)}</article>", "Report|" + C),
    (f"<article><h1>Ferry</h1>{p(0, 1, 2)}</article><section class=comments><h3>Comments</h3><div class=comment><b>ann</b><p>My grandfather was on that ship, what a story.</p></div><div class=comment><b>bo</b><p>Nicely told, thank you very much.</p></div></section>", "Ferry|" + A),
    (f"<table><tr><td><ul>{li('One', 'Two', 'Three', 'Four')}</ul></td><td><h1>Bread</h1>{p(3, 4, 5)}</td></tr></table>", "Bread|" + B),
    (f"<section><h1>Day</h1>{p(6, 7)}<ul><li>{P[8]}</li></ul></section><form action=/s><label>Search</label><input name=q><button>Go</button></form>", "Day|" + C),
    (f"<main><article><h1>Log</h1><p>{P[0]} <a href=/l>The log</a> tells more.</p>{p(1, 2)}</article></main><nav class=breadcrumb><a href=/>Home</a> <a href=/x>Ships</a></nav>", f"Log|{P[0]} The log tells more.|{P[1]}|{P[2]}"),
    (f"<body><div class=c1><div class=c2><div class=c3><h1>Deep</h1>{p(3, 4, 5)}</div></div></div><div class=related><h3>Read next</h3><ul>{li('Salt', 'Yeast', 'Ovens')}</ul></div></body>", "Deep|" + B),
    (f"<article><header><h1>Town</h1></header>{p(6, 7, 8)}<footer>Printed on page 4</footer></article>", None),
    (f"<article><h1>Code</h1>{p(3)}<pre>mix(flour, water)\nbake(60)</pre>{p(4)}</article><div class=sidebar>{MENU}</div>", f"Code|{P[3]}|mix(flour, water) bake(60)|{P[4]}"),
    (f"<article><h1>Table</h1>{p(6)}<table><tr><th>Year</th><th>Buses</th></tr><tr><td>2023</td><td>14</td></tr></table>{p(7)}</article>", f"Table|{P[6]}|Year|Buses|2023|14|{P[7]}"),
    (f"<body><script>var x = '<p>{P[0]}</p>';</script><style>p {{ color: red }}</style><div class=entry><h1>Quiet</h1>{p(0, 1, 2)}</div></body>", "Quiet|" + A),
    (f"<div class=post><h1>Caf&eacute; &amp; rye</h1>{p(3, 4)}</div><div class=newsletter><p>Subscribe to our letter and get a recipe every week.</p><form><input></form></div>", f"Café & rye|{P[3]}|{P[4]}"),
    (f"<body><div class=login><form><p>Log in to read more.</p><input></form></div><div id=main><h1>Buses</h1>{p(6, 7, 8)}</div><div class=promo><p>Two for one on all winter coats this week only.</p></div></body>", "Buses|" + C),
    (f"<article><h1>Masts</h1>{p(0)}<figure><img src=a.png></figure>{p(1)}<aside><h3>See also</h3><p>Ships of the north, and how they were built.</p></aside>{p(2)}</article>", "Masts|" + A),
    (f"<main><h1>Long</h1>{''.join(f'<p>{P[i % 9]} Part {i}.</p>' for i in range(60))}</main><footer><ul>{li('Terms', 'Privacy')}</ul></footer>", "Long|" + "|".join(f"{P[i % 9]} Part {i}." for i in range(60))),
    (f"<div role=navigation>{MENU}</div><div role=main><h1>Roles</h1>{p(3, 4, 5)}</div><div role=complementary><p>Sponsored by the millers of the valley.</p></div>", "Roles|" + B),
    (f"<body><div class=header><p>Daily paper of the coast</p></div><div class=text><h1>Winter</h1><div>{P[6]}</div><div>{P[7]}</div><div>{P[8]}</div></div></body>", "Winter|" + C),
    (f"<article><h1>Steps</h1>{p(3)}<ol><li>{P[4]}</li><li>{P[5]}</li></ol></article><div class=share><a href=/f>Share</a> <a href=/t>Tweet</a></div><div class=comments><p>I tried it and it was too sour for me.</p></div>", "Steps|" + B),
]


@pytest.fixture(scope="module")
def model():
    return H.train(pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()[:100])


def text_of(html, model):
    root, order = H.parse(html)
    return H.blocks_of(root, H.kept(order, H.scores(model, [order])[0]))


def test_pages_written_by_hand(model):
    right = lost = extra = 0
    for html, wanted in PAGES:
        if wanted is None:
            continue
        got, want = text_of(html, model), wanted.split("|")
        right += len([b for b in want if b in got])
        lost += len([b for b in want if b not in got])
        extra += len([b for b in got if b not in want])
    print(right, lost, extra)
    assert right >= 0.95 * (right + lost) and extra <= 0.05 * right


def test_decoding_is_the_best_of_all_consistent_choices():
    """No kept element without its parent; of all such choices, the one of greatest weighted score."""
    rng = random.Random(3)
    for _ in range(80):
        def tree(depth):
            return "<div>" + "".join(rng.choice(["word " * rng.randint(1, 6), tree(depth + 1) if depth < 2 else ""]) for _ in range(rng.randint(0, 3))) + "</div>"

        _, order = H.parse(tree(0) + tree(1))
        order = order[:12]
        inside = {id(n) for n in order}
        if any(isinstance(c, H.Node) and id(c) not in inside for n in order for c in n.children):
            continue
        scores = np.array([rng.uniform(-2, 2) for _ in order])
        weight = [s * (1 + n.letters**0.5) for n, s in zip(order, scores, strict=True)]
        place = {id(n): i for i, n in enumerate(order)}
        best = -1e9
        for choice in itertools.product((0, 1), repeat=len(order) - 1):
            chosen = (1, *choice)
            if all(not c or n.parent is None or chosen[place[id(n.parent)]] for c, n in zip(chosen, order, strict=True)):
                best = max(best, sum(w for w, c in zip(weight, chosen, strict=True) if c))
        keep = H.kept(order, scores)
        assert np.isclose(sum(w for w, n in zip(weight, order, strict=True) if id(n) in keep), best)
        assert all(n.parent is None or id(n.parent) in keep for n in order if id(n) in keep)


def test_slices_give_the_same_scores(model, monkeypatch):
    pages = [H.parse(html)[1] for html, _ in PAGES]
    whole = [model.log_odds(H.features(order)) for order in pages]
    for size in (1, 7, 10_000):
        monkeypatch.setattr(H, "SLICE", size)
        assert all(np.allclose(a, b) for a, b in zip(H.scores(model, pages), whole, strict=True))


def test_large_pages_take_bounded_memory(model):
    """200 pages of 30,000 elements each, one after the other as a task reads them."""
    page = "<body><nav>" + MENU + "</nav><article>" + "<p><b>x</b> y</p>" * 15_000 + "</article></body>"
    before, top = psutil.Process().memory_info().rss, 0
    for _ in range(6):
        assert len(text_of(page, model)) >= 15_000
        top = max(top, psutil.Process().memory_info().rss - before)
    assert top < 400 << 20
