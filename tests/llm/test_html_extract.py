import html
import random
import re

import numpy as np
import pytest

from tessera.llm.html_extract import Labeller, Maker, blocks, extract, features, main_texts, padded, sigmoid, stored, trained


@pytest.fixture(scope="module")
def model():
    return trained()


def test_blocks():
    page = "<p>a <b>b</b>c&amp;d\n e<br>f<p>g</p><script>var t='</p><p>no';</script><!-- <p>no --><div class='x y' id=z>h<style>q</style> i</div>tail < 3 &#233; <td>j<td>k"
    assert [t for t, *_ in blocks(page)] == ["a bc&d e", "f", "g", "h i", "tail < 3 é", "j", "k"]
    one, other = (blocks(x)[0][1] for x in ("<div class='x y' id=z>h</div>", "<div>h</div>"))
    assert (blocks(page)[3][1] == one).all() and (one != other).any()
    deep = [blocks("<div class='comments'>" * k + "<div>" * 200 + "x")[0][1] for k in (0, 1, 2)]
    assert (deep[0] != deep[1]).any() and (deep[1] == deep[2]).all()  # no depth is too deep, and none counts twice
    assert [t for t, *_ in blocks("<p>x <math><mi>y</mi></math> <svg><text>z</text></svg></p><xmp>a <b>&amp;</xmp>")] == ["x y z", "a <b>&amp;"]
    assert blocks("") == [] and blocks("<script>x") == [] and blocks("<!-- x") == []
    assert blocks("just text")[0][0] == "just text"
    assert [t for t, *_ in blocks("</p></div>a</x>b<p")] == ["a", "b<p"]
    assert blocks("<a href=x>all</a>")[0][2] == 3
    assert len(blocks("<div>" * 30_000 + "x" + "</p>" * 30_000 + "<p " * 30_000 + "<a href='" * 20_000)) == 2  # linear in depth


def test_gradients():
    maker, model = Maker(1), Labeller()
    some = [maker.example() for _ in range(3)]
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = padded([e[0] for e in some])
    y = padded([e[1][:, None] for e in some])[0][:, :, 0]

    def loss():
        p = sigmoid(model.forward(x, mask))
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    keep = []
    grad = model.backward(x, (sigmoid(model.forward(x, mask, keep)) - y) * mask, keep)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = model.p[name][at]
        model.p[name][at] = was + 1e-2
        up = loss()
        model.p[name][at] = was - 1e-2
        slope = (up - loss()) / 2e-2
        model.p[name][at] = was
        assert abs(slope - g[at]) < 0.02 * abs(slope) + 0.02


@pytest.mark.parametrize("held, least", [(False, 0.985), (True, 0.96)])
def test_unseen_layouts(model, held, least):
    """``held``: names of rooms and junk, and shares of table layouts, that training never saw."""
    maker = Maker(77, held)
    some = [e for e in (maker.example() for _ in range(300)) if len(e[1])]
    got = model.label([x for x, _ in some])
    assert np.mean(np.concatenate([a == (y > 0) for a, (_, y) in zip(got, some, strict=True)])) > least


P = ["The council met on Tuesday to talk about the new bridge over the river.", "Several members asked how long the work would take, and what it would cost.", "An engineer explained that the old pillars can stay where they are.", "In the end the plan was accepted by a large majority.", "Work begins in spring, once the water is low enough."]
PS = "".join(f"<p>{x}</p>" for x in P)
LINKS = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "World", "Sports", "Culture"))
ALL = " ".join(P)
#: Pages written by hand, away from the generator, with their main text.
BY_HAND = [
    (f"<body><ul class='globalnav'>{LINKS}</ul><div class='story-body'>{PS}</div><div class='site-foot'>© 2021 All rights reserved</div></body>", ALL),
    (f"<div class='wrap'><div class='txt-block'>{PS}</div></div>", ALL),
    (f"<nav>{LINKS}</nav><main><section>{PS}</section></main><footer>Privacy Terms</footer>", ALL),
    (f"<main>{PS}</main><section id='user-comments'><h3>3 Comments</h3><div><p>Ann wrote: great news</p></div><div><p>Bob says: too late</p></div></section>", ALL),
    (f"<header><h1>The Daily</h1></header><article>{PS}</article><aside><h4>Most read</h4><ul>{LINKS}</ul></aside>", ALL),
    (f"<article>{PS}<div class='advert'>Buy now! Sale</div><p>Last words here.</p></article>", f"{ALL} Last words here."),
    ("<article>" + "<br><br>".join(P) + "</article>", ALL),
    (f"<table><tr><td><ul>{LINKS}</ul></td><td class='content'>{PS}</td></tr></table>", ALL),
    ("<article>" + "".join(f"<div><div>{x}</div></div>" for x in P) + "</article>", ALL),
    (f"<div id='cookie-banner'>We use cookies <button>Accept</button></div><article><h1>Bridge</h1>{PS}</article>", f"Bridge {ALL}"),
    (f"<form><label>Search</label><input></form><div id='content'><h2>Bridge</h2>{PS}</div>", f"Bridge {ALL}"),
    ("<article>" + "".join(f"<p>{x}" for x in P), ALL),
    (f"<ARTICLE CLASS=Post><P>{P[0]}</P><TABLE><TR><TD>one<TD>two</TABLE></ARTICLE>", f"{P[0]} one two"),
    (f"<main><blockquote>{P[0]}</blockquote><pre>{P[1]}</pre><ul><li>{P[2]}</li></ul></main>", " ".join(P[:3])),
    (f"<article>{PS}<p>x <math><mi>y</mi></math> z</p></article>", f"{ALL} x y z"),
    (f"<main>{PS}</main><div class='comments'>" + "<div>" * 70 + "<p>I like this very much, says reader</p>" + "</div>" * 70 + "</div>", ALL),
    ("<div>" * 90 + f"<article>{PS}</article>" + "</div>" * 90, ALL),
    (f"<div role='navigation'>{LINKS}</div><div role='main'>{PS}</div><div role='contentinfo'>Copyright</div>", ALL),
    (f"<div class='newsletter-signup'>Subscribe to our newsletter</div><article>{PS}</article><div class='share-bar'><a href=x>Tweet</a></div>", ALL),
    (f"<nav>{LINKS}</nav><footer>Imprint</footer>", ""),
]
BR = "<br><br>".join(P)
TALK = ["I walked over that bridge as a child and I hope they keep the old stones.", "Nobody asked the people who live on the other side, as usual."]
SAID = "".join(f"<p>{x}</p>" for x in TALK)
#: Pages without a room of their own, with captions, noscript, names that say nothing, and comments that read like prose.
ODD_BY_HAND = [
    (f"<html><body>{PS}</body></html>", ALL),
    (f"<body><h1>Bridge</h1>{PS}</body>", f"Bridge {ALL}"),
    (f"<body><font face='Arial'>{BR}</font></body>", ALL),
    (f"<body><center>{PS}</center></body>", ALL),
    (f"<body bgcolor=white><font size=2>{P[0]}<br><br>{P[1]}<br><br></font></body>", " ".join(P[:2])),
    (f"<body><ul>{LINKS}</ul>{PS}<div class='footer'>Copyright 2020</div></body>", ALL),
    (f"<article>{PS}<figure><img src=x><figcaption>The bridge in winter.</figcaption></figure></article>", f"{ALL} The bridge in winter."),
    (f"<article>{PS}<noscript><p>The river at night.</p></noscript></article>", f"{ALL} The river at night."),
    (f"<noscript>Please enable JavaScript.</noscript><nav>{LINKS}</nav><article>{PS}</article>", ALL),
    (f"<main>{PS}</main><section class='comments'><h3>2 comments</h3>{SAID}</section>", ALL),
    (f"<article>{PS}</article><div id='comments'><h2>Discussion</h2><ul><li>{TALK[0]}</li><li>{TALK[1]}</li></ul></div>", ALL),
    (f"<main>{PS}</main><aside class='sidebar'><h3>Popular</h3><ul>{LINKS}</ul></aside>", ALL),
    (f"<div class='sidebar'><h4>Popular</h4><ul>{LINKS}</ul></div><div class='content'>{PS}</div>", ALL),
    (f"<div class='a8f3'><ul>{LINKS}</ul></div><div class='k29x'>{PS}</div><div class='zq1'>Terms and conditions apply</div>", ALL),
    (f"<nav class='x7d'>{LINKS}</nav><main class='p0q'>{PS}</main><footer class='u3'>Imprint</footer>", ALL),
    (f"<main class='css-1x'><h1>Bridge</h1>{PS}</main><section class='css-9'><h2>Comments</h2>{SAID}</section>", f"Bridge {ALL}"),
    (f"<article>{PS}<section class='reader-comments'><h4>Leave a reply</h4>{SAID}</section></article>", ALL),
    (f"<body>{PS}<form><label>Email</label><input><button>Subscribe</button></form></body>", ALL),
    (f"<div id='page'><div class='header'>The Daily</div><div id='main'>{PS}</div><div class='related'><h3>More stories</h3><ul>{LINKS}</ul></div></div>", ALL),
    (f"<body><center><h1>Bridge</h1>{BR}</center></body>", f"Bridge {ALL}"),
]


def test_pages_written_by_hand(model):
    got = main_texts([x for x, _ in BY_HAND], model)
    right = [a == b for a, (_, b) in zip(got, BY_HAND, strict=True)]
    assert sum(right) >= 17, [BY_HAND[k][0][:90] for k, ok in enumerate(right) if not ok]


def test_odd_pages_written_by_hand(model):
    got = main_texts([x for x, _ in ODD_BY_HAND], model)
    right = [a == b for a, (_, b) in zip(got, ODD_BY_HAND, strict=True)]
    assert sum(right) >= 17, [(ODD_BY_HAND[k][0][:90], got[k]) for k, ok in enumerate(right) if not ok]


def test_parts_of_a_page_are_one_page(model):
    """Long pages go by in parts: where they are cut makes no difference, and memory doesn't grow with a page's dense numbers."""
    maker = Maker(5)
    pages = [maker.example()[0] for _ in range(7)]
    whole = model.forward(*padded(pages))
    for at_once in (1, 30, 1 << 14):
        cut = model.logits(pages, at_once)
        assert all(np.allclose(a[: len(p)], b[: len(p)], atol=1e-4) for a, b, p in zip(whole, cut, pages, strict=True))
    many = blocks("<div class='k'>ab<p>cd" * 20_000)
    assert len(many) == 40_000 and len({id(path) for _, path, *_ in many}) == 3  # the first div has no other around it
    assert features([many])[0].paths.shape[0] == 3
    assert blocks("x<noscript><p>y</p></noscript><template>z</template>")[1][0] == "y"


def test_weights_are_stored_once(spark, model):
    import tessera.llm.html_extract as module

    first = stored(spark)
    assert all((first.p[k] == model.p[k]).all() for k in model.p)
    kept, module.trained = module.trained, None  # a second run must not train
    try:
        assert all((stored(spark).p[k] == model.p[k]).all() for k in model.p)
    finally:
        module.trained = kept


def test_article_template(model):
    r = random.Random(3)
    words = lambda n: " ".join(r.choice("the of thtion ermen das ist que niño été".split()) for _ in range(n))
    pages, want = [], []
    for _ in range(60):
        paragraphs = [words(r.randint(1, 80)) + r.choice([".", " &amp; x", "!!"]) for _ in range(r.randint(1, 30))]
        body = f"<h1>{paragraphs[0]}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        pages.append(f'<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{"".join(f"<li><a href=/x>{words(1)}</a></li>" for _ in range(5))}</ul></nav><div class="ad">{words(8)}</div><aside>{words(20)}</aside><article>{body}</article><div class="comments"><p>{words(12)}</p></div><footer>&copy; {words(6)}</footer>' + r.choice(["</body></html>", ""]))
        want.append(" ".join(html.unescape(re.sub("<[^>]*>", " ", body)).split()))
    got = main_texts(pages, model)
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.95
    assert main_texts(pages[5:6], model) == got[5:6]  # whatever else is in the batch


def test_odd_pages(spark, model):
    long = "<article>" + "".join(f"<p>word {k}</p>" for k in range(3000)) + "</article>"
    rows = [(1, None, "k"), (2, "", "k"), (None, "<p", "k"), (4, long, "k"), (4, long, "k"), (5, "<script>only</script>", "k"), (None, None, "k")]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text string"), model).collect()
    of = {r.page_id: r.main_text for r in got}
    assert len(got) == 7 and of[1] == of[2] == of[5] == "" and all(r.text == "k" for r in got)
    assert of[4].startswith("word 0 word 1") and of[4].endswith("word 2999")
    assert extract(spark.createDataFrame([], "page_id long, html string, text string"), model).count() == 0
    assert main_texts([], model) == []
    clash = extract(spark.createDataFrame([(1, "<article><p>x y z, and more.</p></article>", "own")], "page_id long, `the.html` string, main_text string"), model, html_col="the.html").first()
    assert clash.main_text == "own" and clash._main_text.startswith("x y z")
