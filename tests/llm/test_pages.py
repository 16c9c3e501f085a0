import random

import pytest

from sealedspark.llm import pages

KIND = "page_id long, url string, html string, text string, host string"


def texts(spark, rows):
    """page_id -> text, where ids are unique."""
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame([(*r, "c", "h") for r in rows], KIND)).collect()}


def body(*lines):
    return "<body>" + "".join(f"<div>{x}</div>" for x in lines)


def lcs(a, b):
    """Length of a longest common subsequence by the plain table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_is_longest():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randint(0, 14))] for _ in range(2))
        mask = pages.common(a, b)
        kept, it = [x for x, m in zip(a, mask, strict=True) if m], iter(b)
        assert len(kept) == lcs(a, b) and all(x in it for x in kept)


def test_lcs_in_halves_is_longest(monkeypatch):
    monkeypatch.setattr(pages, "MOST_BITS", 8)
    test_lcs_is_longest()


STORY = "The council met on Monday and agreed to mend the bridge over the river, which had been shut since the flood. Work begins in May and ends before the winter. "


@pytest.mark.parametrize("page", [
    "<nav><a>Home</a><a>News</a></nav><div id=story><p>{}</div>" + "".join(f"<article><h3>Teaser number {i}</h3><p>Read on</article>" for i in range(6)),
    "<ul class=menu><li>Home<li>Contact us now</ul><div class='ad-free story'><p>{}</div>",
    "<div id=menu>Home Contact</div><div class='recipe cookies'><p>{}</div>",
    "<div id=menu>Home Contact</div><div class='cookies'><p>{}</div><div class=footer>Imprint</div>",
])
def test_names_and_teasers_do_not_hide_the_story(spark, page):
    text = STORY.strip()
    assert texts(spark, [(1, "http://h/a", page.format(text)), (2, "http://h/b", page.format(text[::-1].replace("<", "")))])[1] == text


def test_articles(spark):
    art = "<html><body><nav>Menu</nav><header>Top</header><article><h1>A &amp; B</h1><p>One\n two<b>!</b><p>Three<div class='comments'>no</div></article><footer>f</footer>"
    plain = "<body><div>Shared line</div><div>Own text %d</div><div>More %d</div><div>Shared end</div>"
    rows = [(1, "http://h/a", art), (2, "http://k/x/1", plain % (1, 1)), (3, "http://k/x/2", plain % (2, 2)), (4, None, None), (None, "http://[bad", "")]
    assert texts(spark, rows) == {1: "A & B\nOne two!\nThree", 2: "Own text 1\nMore 1", 3: "Own text 2\nMore 2", 4: "", None: ""}
    assert pages.extract(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize(
    "html,want",
    [
        ("<div class='layout no-sidebar'><article><p>A</article></div>", ["A"]),
        ("<div class='post category-social'><p>A</div>", ["A"]),
        ("<form id=aspnetForm><div id=menu>M</div><article><h1>T</h1><p>A</article></form>", ["T", "A"]),
        ("<form id=aspnetForm><p>Some long text of a page in a form</form>", ["Some long text of a page in a form"]),
        ("<nav><a>Menu</a><article><p>A</article>", ["A"]),
        ("<article><p class='share'>Share it<div>A</div></article>", ["A"]),
        ("<article><p>A</article><!-- x <p>b", ["A"]),
        ("<article><p>A</article><div class='x", ["A"]),
        ("<article><p>A &lt;b&gt; &eacute;&nbsp;c\n\n d<script>var x = '<!-- <p>';</script></article>", ["A <b> é c d"]),
        ("<article><p>Teaser</article><div>The real story is a good deal longer than that</div>", ["Teaser", "The real story is a good deal longer than that"]),
        ("<article><p>Long text of the article itself</article><div>Short</div>", ["Long text of the article itself"]),
        ("<div id=comments><p>c</div><div class=site-footer>f</div><div role=search>s</div><div hidden>h</div><p>The text itself, which is longer", ["The text itself, which is longer"]),
        ("<article><div class='comment-list'><p>" + "c " * 500 + "</div><p>A</article>", ["A"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("plain text", ["plain text"]),
        ("<<<>>> &&& <p", ["<<<>>> &&&"]),
    ],
)
def test_parsing(html, want):
    found = pages.lines(html)
    kinds = [k for _, k in found]
    keep = pages.kept(kinds, [len(t) for t, _ in found], [False] * len(found))
    assert [t for (t, _), k in zip(found, keep, strict=True) if k] == want


def test_boilerplate_majority(spark):
    menu, foot = [f"Menu {i}" for i in range(6)], [f"Foot {i}" for i in range(4)]
    own = {i: [f"Line {j} of {i}" for j in range(3)] for i in (1, 2)}
    rows = [(i, f"http://k/x/{i}", body(*menu, *own[i], *foot)) for i in own]
    assert texts(spark, rows) == {i: "\n".join(x) for i, x in own.items()}


def test_addresses_by_query_and_equal_addresses(spark):
    rows = [(i, f"http://h/index.php?id={i}", body("Menu", "News", f"Story {i} with its text", "Foot")) for i in range(6)]
    rows += [(10 + i, "http://k/same", body("Menu", f"Story {i} told here", "Foot")) for i in range(4)]
    got = texts(spark, rows)
    assert all(got[i] == f"Story {i} with its text" for i in range(6)) and all(got[10 + i] == f"Story {i} told here" for i in range(4))


def test_copies_and_versions(spark):
    many = [f"Sentence {i} of the story" for i in range(40)]
    rows = [(i, f"http://c/{i}", body("Same", "page")) for i in range(3)]  # copies: one page, no neighbour
    rows += [(10, "http://v/a", body(*many, "Print")), (11, "http://v/b", body(*many, "Mail"))]  # versions of one page
    rows += [(20, "http://t/a", body("Menu", *many, "Print")), (21, "http://t/b", body("Menu", *many, "Mail")), (22, "http://t/c", body("Menu", "Quite another page"))]
    got = texts(spark, rows)
    assert {got[i] for i in range(3)} == {"Same\npage"} and got[10].split("\n") == [*many, "Print"] and got[20].split("\n") == ["Menu", *many, "Print"]
    assert got[21].split("\n") == [*many, "Mail"] and got[22] == "Quite another page"


def by_brute_force(rows):
    """Differencing of pages of open lines over the whole table: nearest different page, plain LCS length."""
    held = {}
    for _, url, html in rows:
        host, path = pages.address(url)
        lines = tuple(t for t, _ in pages.lines(html))
        held[host, lines] = min(path, held.get((host, lines), path))
    out = {}
    for i, url, html in rows:
        host, path = pages.address(url)
        lines = tuple(t for t, _ in pages.lines(html))
        marks = {x: pages.xxhash.xxh64_intdigest(pages.np.array(pages._prints([(t, 0) for t in x]), pages.np.int64).tobytes()) - (1 << 63) for h, x in held if h == host}
        order = sorted((p, marks[x], x) for (h, x), p in held.items() if h == host)
        at = [x for _, _, x in order].index(lines)
        near = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order)]
        near.sort(key=lambda x: -pages._alike(x[0], order[at][0]))
        shared = [lcs(lines, x) for _, _, x in near]
        good = [n for n in shared if 20 * (len(lines) - n) > len(lines)]
        out[i] = len(lines) - (good[0] if good else shared[0] if len(shared) > 1 else 0)
    return out


def test_equals_brute_force_and_order_of_rows_does_not_matter(spark):
    rnd = random.Random(4)
    parts = [f"Block {i}" for i in range(12)]
    rows = [(i, f"http://h{i % 3}/{rnd.choice('abc')}/{rnd.randrange(40)}?p={rnd.randrange(3)}", body(*rnd.choices(parts, k=rnd.randint(1, 9)))) for i in range(90)]
    rows.append((500, "http://h0/long", body(*(f"w{i} " * 50 for i in range(2000)))))
    want = by_brute_force(rows)
    got = texts(spark, rows)
    assert {i: len(t.split("\n")) if t else 0 for i, t in got.items()} == want
    rnd.shuffle(rows)
    assert texts(spark, rows) == got


def test_repeated_rows(spark):
    row = (1, "http://h/a", body("Menu", "Own line", "Foot"))
    df = spark.createDataFrame([(*r, "c", "h") for r in (row, row, (2, "http://h/b", body("Menu", "Other line", "Foot")), (None, None, "x"))], KIND)
    assert sorted((r.page_id is None, r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect() if r.page_id) == [(False, 1, "Own line", 8)] * 2 + [(False, 2, "Other line", 10)]
