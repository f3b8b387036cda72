import random

import pytest

from snapledger.llm import htmltext
from tests.llm.odd import frame

COLUMNS, TYPES = ("page_id", "url", "html"), ("bigint", "string", "string")


@pytest.mark.parametrize("page, text", [
    ("<p>a &amp;&nbsp; b\n c</p>d", "a & b c\nd"), ("<p>a<br>b<b>c</b></p>", "a bc"), ("", ""), ("plain", "plain"), ("a < b > c", "a < b > c"),
    ("<nav>m</nav><header>h</header><p>x</p><footer>f</footer><aside>s</aside><form>q<input></form>", "x"),
    ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>x", "x"),
    ("<div class='side-bar ad'>no</div><div id=cookie-notice>no</div><p>x</p><section class=comments><p>no</p></section>", "x"),
    ("<article><header><h1>T</h1></header><p>x<div class=comment>no</div></p></article><p>after</p>", "T\nx\nafter"),
    ("<article><p>A long article, word after word.</p></article><div>by us</div>", "A long article, word after word."),
    ("<div id=content><p>The main text of this page.</p></div><article class=card>Card</article>", "The main text of this page."),
    ("<p>see <a>this</a> page</p><div><a>one</a> <a>two</a> or</div>", "see this page"), ("<p>x</p><math><mi>y</mi></math>", "x\ny"),
    ("<article>a</article><article class=comment>no</article>", "a"), ("<ul><li><a>m</a><li><a>n</a></ul><p>real <a>link</a>", "real link"),
    ("<title>t</title><p hidden>no</p><div aria-hidden='true'>no</div><p>yes", "yes"), ("<p>unclosed <b>x<p>y</b>z", "unclosed x\ny z"[:-2] + "z"),
])
def test_blocks(page, text):
    assert "\n".join(x for x, _ in htmltext.candidate_blocks(page)) == text


@pytest.mark.parametrize("page, text", [
    ('<p title="the hidden cost of x">a</p><p data-note="a hidden gem">b</p><p class=x HIDDEN>no</p><p hidden="">no</p>', "a\nb"),
    ('<article><section id="related-work"><h2 id="search">a</h2>b</section><h2 id="share-of-votes">c</h2></article>', "a\nb\nc"),
    ('<article><div class="login-example">a</div><div class="x share-buttons">no</div><div role=navigation>no</div></article>', "a"),
    ('<div class="search-results-explained">a</div><div class="notice-of-death">b</div><div class="content has-sidebar">c</div>'
     '<div class="page-header-fixed layout">d</div>', "a\nb\nc\nd"),
    ('<main>a<div class=newsletter>no</div><div class="cookie-notice">no</div><div class=sidebar>no</div><div id=comments>no</div>'
     '<div class="related-posts">no</div><div class="ad-slot">no</div><div class="site-search">no</div></main>', "a"),
    ('<div class="site-header">no</div>a<main><div class="header">b</div></main>', "a\nb"),
    ('<article id="related-work">a</article>', "a"), ('<section id="related-work">a</section><h2 id="search">b</h2>', "a\nb"),
])
def test_article_text_is_not_taken_for_noise(page, text):
    assert "\n".join(x for x, _ in htmltext.candidate_blocks(page)) == text


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("halved", [False, True])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, halved):
    rng = random.Random(9)
    if halved:
        real = htmltext._lengths
        monkeypatch.setattr(htmltext, "_lengths", lambda a, b: real(a, b))
    for _ in range(1500):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = htmltext.common_lines(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and all(any(a[i] == y for y in rest) for i in got) and len(got) == plain_length(a, b)
        assert htmltext._lengths(a, b).tolist() == [plain_length(a, b[:j]) for j in range(len(b) + 1)]


def run(spark, rows):
    got = htmltext.extract(frame(spark, rows, COLUMNS, TYPES)).collect()
    return {r["page_id"]: r["text"] for r in got}


def test_lines_shared_with_the_nearest_page_go(spark):
    page = lambda i: f"<div>Site name</div><div>Today's offer</div><p>Story {i} begins</p><p>and ends {i}</p><div>Imprint</div>"
    rows = [(i, f"http://h.example/news/{i}", page(i)) for i in range(40)]
    rows += [(100, "http://other.example/news/1", page(100)), (101, None, page(101)), (102, "http://h.example/news/7", page(7))]
    got = run(spark, rows)
    for i in range(40):
        assert got[i] == f"Story {i} begins\nand ends {i}"
    assert got[100].startswith("Site name\n") and got[101].endswith("\nImprint")  # no neighbour on their host
    assert got[102] == got[7]  # a copy is no neighbour


def test_declared_articles_are_left_whole(spark):
    rows = [(i, f"http://h.example/{i}", f"<div>menu</div><article><p>same line</p><p>own {i}</p></article>") for i in range(5)]
    assert run(spark, rows) == {i: f"same line\nown {i}" for i in range(5)}


def test_template_lines_inside_declared_articles_go(spark):
    """A line of the site goes from the articles of the host; one that two of its pages share stays."""
    page = lambda i: f"<article><h1>Story {i}</h1><p>It begins {i}</p><p>pair {i // 2}</p><div>Share this story</div></article>"
    rows = [(i, f"http://h.example/news/{i:02d}", page(i)) for i in range(30)]
    rows += [(100, "http://h.example/news/00/copy", page(0)), (101, "http://other.example/1", page(101))]
    got = run(spark, rows)
    for i in range(30):
        assert got[i] == f"Story {i}\nIt begins {i}\npair {i // 2}"
    assert got[100] == got[0] and got[101].endswith("Share this story")


@pytest.mark.parametrize("count", [2, 5, 6, 30])
def test_prose_stays_however_many_pages_share_it(spark, count):
    recipe = lambda i: f"<div>Cook book</div><h1>Dish {i}</h1><p>Preheat the oven to 180 degrees.</p><p>Add {i}.</p><div>Imprint</div>"
    story = lambda i: f"<article><h1>Story {i}</h1><p>It is told {i}.</p><p>All rights are free.</p></article>"
    got = run(spark, [(i, f"http://h.example/{i:02d}", recipe(i)) for i in range(count)]
              + [(100 + i, f"http://s.example/{i:02d}", story(i)) for i in range(count)])
    for i in range(count):
        assert got[i] == f"Dish {i}\nPreheat the oven to 180 degrees.\nAdd {i}."
        assert got[100 + i] == f"Story {i}\nIt is told {i}.\nAll rights are free."


def plain_extract(rows):
    """All pages of a host at once: neighbours by sorting, a table for the subsequence, the rules line by line."""
    pages = {}
    for _, url, text in rows:
        host, path = htmltext._url_parts(url)
        found = htmltext.candidate_blocks(text or "")
        if found:
            pages.setdefault(host, {}).setdefault(htmltext._key(found), []).append((path, found))
    out = {}
    for host, known in pages.items():
        order = sorted((min(p for p, _ in same), key, same[0][1]) for key, same in known.items())
        for at, (path, key, found) in enumerate(order):
            beside = [order[i] for i in (at - 1, at + 1) if 0 <= i < len(order)]
            beside.sort(key=lambda x: -next((i for i, (a, b) in enumerate(zip(path, x[0])) if a != b), min(len(path), len(x[0]))))
            drop, lines = [], [x for x, _ in found]
            for _, _, other in beside:
                shared = htmltext.common_lines(htmltext._hashes(lines), htmltext._hashes([x for x, _ in other]))
                assert len(shared) == plain_length(lines, [x for x, _ in other])
                if len(shared) < 0.8 * len(lines):
                    drop = shared
                    break
            kept = []
            for i, (text, flags) in enumerate(found):
                between = any(j not in drop for j in range(i)) and any(j not in drop for j in range(i + 1, len(found)))
                article, prose = flags & 1, flags & 2
                stays = i not in drop or prose and (article or between) or article and between
                kept += [text] if stays else []
            out[host, key] = "\n".join(kept)
    return [(i, out.get((htmltext._url_parts(url)[0], htmltext._key(htmltext.candidate_blocks(text or ""))), "")) for i, url, text in rows]


def test_against_plain_version(spark, small):
    rng = random.Random(8)
    line = lambda: rng.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>", "<h2>{}</h2>"]).format(f"line {rng.randrange(12)}")
    rows = []
    for i in range(250):
        body = "".join(line() for _ in range(rng.randrange(9)))
        body = rng.choice(["{}", "<article>{}</article>", "<div>top</div><main>{}</main><div>end</div>"]).format(body)
        rows.append((i, f"http://h{rng.randrange(4)}.example/{rng.choice('ab')}/{rng.randrange(60)}", body))
    rows += [(1000 + r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert run(spark, rows) == dict(plain_extract(rows))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "<p>x"), (3, "no url", "<p>x"), (None, "http://a/b", "<p>y"), (4, "http://a/b", "<div>" * 30_000 + "z"),
            (5, "http://a/c", "w " * 200_000)]
    df = htmltext.extract(frame(spark, rows, COLUMNS, TYPES))
    assert df.columns.count("text") == 1
    assert sorted((str(r["page_id"]), r["text"]) for r in df.collect()) == sorted(
        [("1", ""), ("2", ""), ("3", "x"), ("3", "x"), ("None", "y"), ("4", "z"), ("5", " ".join(["w"] * 200_000))])
    assert htmltext.extract(frame(spark, [], COLUMNS, TYPES)).count() == 0
