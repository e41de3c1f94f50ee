import pytest

from clipwright.llm import html_crf as h


@pytest.fixture(scope="module")
def model():
    return h.trained()


PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site-header"><div>Logo</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div><!-- <p>hidden</p> -->
<article><h1>Title &amp; more</h1><p><b>First   part<br>goes on.<p>Second &lt;i&gt; part.</p><div class="ad">Buy this thing now.</div>
<ul><li>One point made here.</li></ul><p>Last one.</p></article>
<section class="comments"><h2>Comments</h2><p>I liked this article very much, thank you.</p></section>
<aside class="sidebar"><h3>Related</h3><a href="/c">Other story</a></aside><form><label>Mail</label><input name="q"><button>Send</button></form>
<footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_article_only(model):
    text, kept, total = h.main_text(PAGE, model)
    assert text.split("\n") == ["Title & more", "First part goes on.", "Second <i> part.", "One point made here.", "Last one."]
    assert kept == 5 and total > 10


def test_held_out_layouts(model):
    wrong = total = 0
    for page, labels in h.labelled_pages(200, seed=77):
        blocks = h.leaf_blocks(page)
        assert len(blocks) == len(labels)
        wrong += sum(a != b for a, b in zip(model.decode(h.block_features(blocks)), labels))
        total += len(labels)
    assert wrong <= 0.01 * total


@pytest.mark.parametrize("named", [0.9, 0.0])
def test_names_and_layouts_that_training_never_saw(model, named):
    other = {hint: tuple(words.split()[1::2]) for hint, words in h.HINTS.items()}
    assert not any(set(other[k]) & set(h.TRAINED_NAMES[k]) for k in other)
    wrong = total = 0
    for page, labels in h.labelled_pages(200, seed=78, names=other, wrappers=("section", "div div div", "center"), named=named):
        blocks = h.leaf_blocks(page)
        assert len(blocks) == len(labels)
        wrong += sum(a != b for a, b in zip(model.decode(h.block_features(blocks)), labels))
        total += len(labels)
    assert wrong <= 0.01 * total


def test_parts_without_telling_names(model):
    body = "".join(f"<p>{'Some words of the article that goes on. ' * n}</p>" for n in (5, 6, 4))
    page = f"""<body><div class="zone-a"><p>We use cookies on this site to make it better.</p></div><div class="zone-b"><h1>The title</h1>{body}</div>
<div class="zone-c"><p>I liked this a lot, thanks.</p><p>Me too, said the other.</p></div><div class="zone-d"><p>All of it by us</p></div></body>"""
    text, kept, _ = h.main_text(page, model)
    assert kept == 4 and text.startswith("The title\nSome words") and "cookies" not in text and "liked" not in text


def test_names_inside_an_article(model):
    page = '<article><p class="comment-on-law">The law is as it is.</p><p class="lead share-price">The price went up again.</p><p>Third block here.</p></article>'
    assert h.main_text(page, model)[0].split("\n") == ["The law is as it is.", "The price went up again.", "Third block here."]


def test_paragraphs_and_nothing_else(model):
    page = "<body><div>First paragraph of it, with some words.</div><div>Second paragraph of it, with more words.</div></body>"
    assert h.main_text(page, model)[1] == 2


def test_choices_inside_an_article(model):
    page = "<body><article><h1>Title</h1><p>Some text is here.</p><select><option>One</option><option>Two</option></select><p>More text is here.</p></article></body>"
    assert h.main_text(page, model)[0] == "Title\nSome text is here.\nMore text is here."


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<div>" * 10_000 + "x", "<div>x" * 10_000, "<center>" * 10_000 + "<ul>" + "<li>a</li>" * 10_000, "<!" * 500_000, '<a x="' * 170_000, "<a x='" * 80_000 + '<b y="' * 80_000, "</div>" * 170_000, "<p " + "x" * 1_000_000],
    ids=range(9),
)
def test_time_grows_with_the_page(model, page):
    import time

    began = time.perf_counter()
    h.main_text(page, model)
    assert time.perf_counter() - began < 5


def test_viterbi_is_the_best_path(model):
    from itertools import product

    page = h.labelled_pages(30, seed=5)
    for html, _ in page:
        features = h.block_features(h.leaf_blocks(html))[:9]
        score = lambda ls: sum(sum(model.unary[f]) if l else 0.0 for f, l in zip(features, ls)) + sum(model.pair[int(a)][int(b)] for a, b in zip(ls, ls[1:]))  # noqa: E731, E741
        best = max(product((False, True), repeat=len(features)), key=score)
        assert model.decode(features) == list(best)


def test_forward_backward_fits_its_data():
    pages = [([[0, 1], [0, 2], [0, 1]], [True, False, True])] * 5 + [([[0, 2]], [False])] * 3
    crf = h.fit_crf(pages, steps=200)
    assert all(crf.decode(f) == y for f, y in pages)


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "plain text", "<p>a</div></p></ul>b", "&#0; &bogus; &#xFFFFFF;", "<script>never ends", "<!-- open", "<p class='x" + "y" * 10_000])
def test_broken_pages(model, page):
    text, kept, total = h.main_text(page, model)
    assert isinstance(text, str) and kept <= total


def test_query_table(spark, model):
    rows = [(1, "u", PAGE, "t", 0), (1, "u", PAGE, "t", 0), (2, None, None, None, None), (None, "u", "", "t", 1), (3, "u", "<article><p>" + "word " * 300_000 + "</p></article>", "t", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = h.extract_text(table, model).collect()
    assert len(found) == 5 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert [r["n_chars"] for r in found if r["page_id"] == 3] == [300_000 * 5 - 1]
    assert h.extract_text(table.limit(0), model).count() == 0


@pytest.mark.parametrize("icon", ['<svg class="i"/>', "<svg/>", "<svg hidden/>", '<svg viewBox="0 0 1 1" />', "<math/>", '<SVG class="a b"/>', "<svg class='i'><path d='M0 0'/></svg>", "<svg class=i/><path/></svg>"])
def test_icons_lose_no_text(model, icon):
    first, second = "The first paragraph of the article is here. " * 5, "And the second paragraph of it goes on. " * 5
    between = h.main_text(f"<body><article><h1>Title</h1><p>{first}</p>{icon}<p>{second}</p></article></body>", model)[0]
    assert between.split("\n") == ["Title", first.strip(), second.strip()]
    within = h.main_text(f"<body><article><h1>Title</h1><p>{first}{icon}{second}</p><p>{second}</p></article></body>", model)[0]
    assert within.split("\n") == ["Title", first + second.strip(), second.strip()]


def test_icons_cost_their_length(model):
    import time

    began = time.perf_counter()
    h.main_text("<svg/>" * 100_000 + "<svg " + "=" * 300_000 + "/>" + "<svg class=x/" * 50_000, model)
    assert time.perf_counter() - began < 20
