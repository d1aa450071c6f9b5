import numpy as np
import pytest

from panelforge.llm import pages as p


@pytest.fixture(scope="module")
def extract():
    model = p.Model()

    def run(html):
        forest = p.Forest()
        forest.add(html)
        kept = model.marginals(forest)[0] > 0.5
        return "\n".join(t for t, k in zip(forest.text, kept) if k and t is not None)

    return run


PAGES = {
    "plain": ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1>"
              "<p>One  two\n three.<p>Four <b>five</b>.</article><footer>&copy; x</footer></body></html>", "A & B\nOne two three.\nFour five."),
    "named": ('<body><div class="site-header"><a href="/">Site</a></div><div id="cookie-notice">We use cookies, please accept them all today.</div>'
              '<div class="post-content"><h2>Title</h2><p>Text of some length, with words.</p><div class="advert">Buy this now, it is cheap.</div><p>More.</p>'
              '<ul><li>first</li><li><a href="x">second</a></li></ul></div><div class="sidebar"><p>Other reading on this site.</p></div>'
              '<section id="comments"><p>I disagree with all of this, said a reader.</p></section></body>',
              "Title\nText of some length, with words.\nMore.\nfirst\nsecond"),
    "main": ('<main><header><h1>Name</h1></header><p>Body &eacute;&#8212;&lt;b&gt;.</p><aside>See also</aside><form><p>Subscribe to our letters.</p><input></form></main>'
             "<p>Outside of it, a long enough sentence stands here.</p>", "Name\nBody é—<b>."),
    "script": ('<article><p>a<script>if (1 < 2) { x = "</p><p>no" }</script>b</p><!-- <p>c</p> --><noscript>d</noscript><p>e', "ab\ne"),
    "table": ("<article><table><tr><td>1<td>2<tr><td>3</table><p>x<br>y</article>", "1\n2\n3\nx y"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(extract, name):
    html, want = PAGES[name]
    assert extract(html) == want


def test_broken_markup(extract):
    for html in ("", "<", "<p", "<p>x", "</p></div>", "<!-- x", "<script>x", '<a href="x>y', "&#xZZ;", "<p>" * 2000 + "x", "<div>" * 3000, "<article>" + "<b>" * 5000 + "z"):
        extract(html)
    assert extract("<article><p>x < y and &am") == "x < y and &am"


def test_messages_equal_all_states():
    """Marginals of a small tree against the sum over every assignment."""
    forest = p.Forest()
    forest.add("<body><div><p>one two</p>three</div><nav><a>x</a></nav></body>")
    n = len(forest.parent)
    model = p.Model()
    got, both = model.marginals(forest)
    unary = np.array(forest.values) @ model.weights
    total, marginal, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for state in np.ndindex(*[2] * n):
        w = np.exp(sum(unary[i] * state[i] for i in range(n)) + sum(model.edges[forest.kind[q]][state[q], state[i]] for i, q in enumerate(forest.parent) if q >= 0))
        total += w
        marginal += w * np.array(state)
        for i, q in enumerate(forest.parent):
            if q >= 0:
                joint[i, state[q], state[i]] += w
    assert np.allclose(got, marginal / total) and np.allclose(both[1:], (joint / total)[1:])


def test_training_moves_towards_the_labels():
    forest = p.Forest()
    for i in range(30):
        forest.add(f"<nav><a>home {i}</a></nav><div><article><p>Words of page {i}, enough of them.</p></article></div><div class=x>More words {i} that are not the article.</div>")
    y = np.array([bool(x) for x in forest.label])

    def loss(m):
        q = m.marginals(forest)[0]
        return -np.log(np.where(y, q, 1 - q)).mean()

    before = loss(p.Model())
    assert loss(p.Model().fit(forest)) < before


def test_odd_rows(spark, prose):
    long = "<article>" + "".join(f"<p>{prose(i, 50)}</p>" for i in range(2000)) + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>a</p></article>", "x"), (2, "u", "<article><p>a</p></article>", None), (3, "u", long, "x"), (3, "u", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    model = p.train(df)
    got = p.extracted(df, model).collect()
    assert sorted(len(r.main_text) for r in got)[:4] == [0, 0, 1, 1] and len(got) == 6
    assert max(len(r.main_text.split("\n")) for r in got) == 2000
    empty = df.limit(0)
    assert p.extracted(empty, p.train(empty)).collect() == []


def test_parts_of_other_pages(spark):
    """Layouts that the labelled pages do not show: what is not the article goes with all that is in it."""
    shown = p.Forest()
    for i in range(20):
        shown.add(f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Some offer {i}.</div><article><h1>Title {i}</h1><p>Words of page {i}, enough of them.</p></article><footer>c</footer></body>")
    model = p.Model().fit(shown)

    def run(html):
        forest = p.Forest()
        forest.add(html)
        kept = model.marginals(forest)[0] > 0.5
        return [t for t, k in zip(forest.text, kept) if k and t is not None]

    assert run("<header><h1>Site</h1></header><div class='notice'><p>We have updated our terms, please read them.</p></div><main><article><header>"
               "<h1>Story</h1></header><p>Para.</p><div class='ad-slot'><div><p>Buy the thing today, friends.</p></div></div><ul><li>a</li></ul>"
               "<form><p>Give us your mail address.</p></form><section id=comments><article class=comment><p>First! What a nice thing to read.</p>"
               "</article></section></article></main><aside><p>Other things to read on this site today.</p></aside>") == ["Story", "Para.", "a"]
    assert run("<body><table><tr><td><a href=1>Home</a></td><td><h1>Big title</h1><p>This is the article text, long enough to be read.</p></td></tr></table>") == [
        "Big title", "This is the article text, long enough to be read."]


def kept_by(model, html, names=True):
    forest = p.Forest()
    forest.add(html)
    kept = model._passed(p.Nodes(forest, names))[0] > 0.5
    return [t for t, k in zip(forest.text, kept) if k and t is not None]


def test_labels_turn_a_decision_around():
    """On pages that name no article, what is kept follows from the pages that do."""
    shown = p.Forest()
    for i in range(40):
        shown.add(f"<body><div><p>Subscribe to letter {i}, and read it every day.</p></div><article><table><tr><td>cell {i}<td>value {i}</table></article></body>")
    page = "<body><div><p>Subscribe to letter 99, and read it every day.</p></div><div><table><tr><td>cell 99<td>value 99</table></div></body>"
    before, after = kept_by(p.Model(), page), kept_by(p.Model().fit(shown), page)
    assert "cell 99" not in before or "Subscribe to letter 99, and read it every day." in before
    assert after == ["cell 99", "value 99"]


def test_fit_is_at_the_top_of_its_objective():
    """Slopes vanish: marginals meet the labels up to the pull of the prior, however the steps got there."""
    forest = p.Forest()
    for i in range(20):
        forest.add(f"<nav><a>home {i}</a></nav><article><p>Words of page {i}, enough of them.</p><p>short</p></article><div>More words {i} that are not the article.</div>")
    model = p.Model().fit(forest, hold=0.05)
    y, slope = np.array([bool(x) for x in forest.label], int), np.zeros(len(p.PRIOR))
    for names in (True, False):
        nodes = p.Nodes(forest, names)
        slope += nodes.x.T @ (y - model._passed(nodes)[0]) / 40
    assert np.allclose(slope, 0.05 * (model.weights - p.PRIOR), atol=2e-4)


def test_training_explains_pages_without_their_names(spark):
    """Fit on half of the labelled pages, judge runs of text of the other half with all names held back."""
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    halves = [p.Forest(), p.Forest()]
    for i, h in enumerate(rows):
        one = p.Forest()
        one.add(h or "")
        if one.label[0] is not None:
            halves[i % 2].add(h)
    nodes = p.Nodes(halves[1], names=False)
    y, leaf = np.array([bool(x) for x in halves[1].label]), np.array([t is not None for t in halves[1].text])

    def right(model):
        return ((model._passed(nodes)[0] > 0.5) == y)[leaf].mean()

    assert right(p.Model().fit(halves[0])) > max(0.95, right(p.Model()))


def test_walk_by_nodes_equals_walk_by_levels():
    forest = p.Forest()
    for html, _ in PAGES.values():
        forest.add(html)
    nodes, model = p.Nodes(forest), p.Model()
    ways = []
    for walk in (model._by_levels, model._by_nodes):
        up = np.zeros((nodes.n, 2))
        up[:, 1] = nodes.x @ model.weights
        ways.append((*walk(nodes, up), up))
    for a, b in zip(*ways):
        assert np.allclose(a, b)


HOSTILE = ["<div>", "</p>", "<a ", '<a ">"', "<a '\">", "<p>", "<b", "<div class='", "<li><ul>", "<!", "&amp", "<td><form>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_work_is_linear_in_the_markup(piece):
    """Twice the text takes about twice the time: the quadratic scan took sixteen times for four times the text."""
    from time import process_time

    def seconds(n):
        at = process_time()
        forest = p.Forest()
        forest.add("<div>" * (n // 50) + piece * (n // len(piece)) + "'>x")
        p.Model().marginals(forest)
        return process_time() - at

    seconds(1000)
    assert seconds(400_000) < 9 * max(seconds(100_000), 0.05)


def test_quotes_and_formulas():
    model = p.Model()
    assert kept_by(model, "<article><p title='a > b'>One <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == ["One x=2 holds."]
    # Quotes hide the end of a tag wherever they stand in it, so this one ends with the next element's.
    assert kept_by(model, "<article><p>a <a \">\"b</a> c</p></article>") == ["a c"]
    assert kept_by(model, '<article><p>a <b x="y>open</b> c</p></article>') == ["a open c"]
