from __future__ import annotations

from math import log

import duckdb
import pytest

from tallyweave.llm.html import ANCHOR, DOUBT, PROSE, PUNCTUATION, blocks, extract, main_text, path_scores

LONG = "A sentence with several words, some of them long. Another one follows; it is there. "
PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home page</a></li></ul></nav>'
    '<!-- ad 1 --><div class="ad">Buy now. Really, do.</div><article><h1>The title</h1><p><b>First   para&amp;graph.<br><p>Second &lt;one&gt;&nbsp;x.</p>'
    "<ul><li>item one<li>item two</ul><div class='comments'><p>Nice text, really nice, by me.</p></div></article><footer>&copy; us. All rights.</footer></body></html>"
)


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain text only", "plain text only"), ("<p>", ""), ("<nav><a>x</a></nav>", ""), ("<p>a<", "a<"), ("<p title='x>y'>a b</p>", "a b"),
    ("<article><p>one<p>two", "one\n\ntwo"), ("<script>var x = '<p>'", ""), ("<article><p title=\"open>one</p></article>", "one"),
    (PAGE, "The title\n\nFirst para&graph.\n\nSecond <one> x.\n\nitem one\n\nitem two"),
    (f"<body><div><p>{LONG}</p><p>{LONG * 3}</p></div><div><a href=x>more</a> <a href=y>links here</a></div></body>", f"{LONG.strip()}\n\n{(LONG * 3).strip()}"),
    ("<article><p>a &amp b &#233; &#x1F44D; &notanentity;</p></article>", "a & b é 👍 ¬anentity;"),
])
def test_pages(page, want):
    assert main_text(page) == want


TEXT = (LONG * 5).strip()
ITEMS = [f"an item of the list, about forty letters {i}" for i in range(6)]
CELLS = [str(i % 90) for i in range(60)]
LIST = "<ul>" + "".join(f"<li>{x}" for x in ITEMS) + "</ul>"
TABLE = "<table>" + "".join(f"<tr><td>{a}<td>{b}" for a, b in zip(CELLS[::2], CELLS[1::2], strict=True)) + "</table>"
LINKED = "<ol><li><a href=1>first source</a><li><a href=2>second source</a></ol>"
WHOLE = ["The title", TEXT, TEXT, *ITEMS, *CELLS, "first source", "second source", TEXT]


@pytest.mark.parametrize("before,after", [
    ("<body>", ""), ("<body><article>", "</article>"), ("<main>", "</main><p>outside"), ("<body><div>", "</div><div><a href=x>more</a> <a href=y>links</a></div>"),
    ("<table><tr><td><a href=x>one</a> <a href=y>two</a><td>", "</table>"), ("<body><nav>Menu</nav><div><div class=ad>Buy.</div>", "</div><footer>All rights.</footer>"),
])
def test_nothing_else_is_dropped(before, after):
    """Title, list, table and sources stay, framed or not; menus, adverts and what is outside the text don't."""
    page = f"{before}<h1>The title</h1><p>{TEXT}</p><p>{TEXT}</p>{LIST}{TABLE}{LINKED}<p>{TEXT}</p>{after}"
    assert main_text(page).split("\n\n") == WHOLE


def test_title_above_the_text():
    page = f"<h1><a href=/>Site</a></h1><h1>The title</h1><div><p>{TEXT}</p><h2>Part</h2><p>{TEXT}</p></div><div><a href=x>more</a></div>"
    assert main_text(page) == f"The title\n\n{TEXT}\n\nPart\n\n{TEXT}"


@pytest.mark.parametrize("page", [
    "<article><div class='legal'><h2>Part</h2><p>{}</p></div></article>", "<main><div class='alert'><h2>Part</h2><p>{}</p></div></main>",
    "<div id='share-price'><h2>Part</h2><p>{}</p></div>", "<div class='content-header'><h2>Part</h2><p>{}</p></div>",
    "<article><section class='search'><h2>Part</h2><p>{}</p></section></article>", "<nav>Menu</nav><div class='ad'>Buy, now.</div><div class='notice'><h2>Part</h2><p>{}</p></div>",
])
def test_long_text_outweighs_a_doubted_name(page):
    assert main_text(page.format(TEXT)) == f"Part\n\n{TEXT}"


def test_doubts_decide_between_texts():
    notice, comment = "<div class=notice><p>A notice, not long.</p></div>", f"<div class=comments><p>{TEXT}</p></div>"
    assert main_text(f"<article><p>{TEXT}</p>{notice}{comment}</article><div><p>{LONG}</p></div>") == TEXT
    assert main_text(f"<div><p>{TEXT}</p>{notice}</div>") == TEXT
    assert main_text("<article></article><div class=ad><p>Buy now, really.</p></div>") == ""
    assert main_text("<main><h1>Welcome</h1></main><div>" + f"<p>{TEXT * 9}</p>" * 4 + "</div>") == "\n\n".join(["Welcome"] + [TEXT * 9] * 4)


def brute_scores(page):
    """The scoring over again, each path's averages and each block's neighbours looked up from the start."""
    def average(path, what):
        own = [b for b in page if b.path == path]
        return sum(map(what, own)) / len(own)

    def fused(b):
        chars, marks = average(b.path, lambda o: len(o.text)), average(b.path, lambda o: sum(bool(PUNCTUATION.match(c)) for c in o.text))
        return log(1 + chars), log(1 + marks), 1 - average(b.path, lambda o: min(o.linked, len(o.text))) / chars

    known = [fused(b) for b in page]

    def smooth(i, k):
        pairs = [(w, known[i + d][k]) for d, w in ((-2, 1), (-1, 2), (0, 4), (1, 2), (2, 1)) if 0 <= i + d < len(page)]
        return sum(w * v for w, v in pairs) / sum(w for w, _ in pairs)

    out = {}
    for b in {b.path: b for b in page}.values():
        mine = [smooth(i, 0) * (1 + smooth(i, 1)) * known[i][2] for i, o in enumerate(page) if o.path == b.path]
        long, punctuated, _ = fused(b)
        factor = (1 if b.element.weight == 1 else DOUBT if long * (1 + punctuated) >= PROSE else 0) * (1 if b.element.inside or not any(o.element.inside for o in page) else DOUBT)
        out[b.path] = sum(mine) / len(mine) * factor
    return out


def test_scores_decide_on_the_given_pages():
    """The scores are those of a plain version, and on most pages they choose the anchors."""
    decided = 0
    pages = [h or "" for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    for page in pages:
        good = [b for b in blocks(page) if b.element.weight > 0]
        score = path_scores(good)
        assert score == pytest.approx(brute_scores(good))
        if not good:
            continue
        decided += max(score.values()) > 0
        anchors = [b for b in good if score[b.path] >= ANCHOR * max(score.values())]
        assert all(b.text in main_text(page) for b in anchors)
    assert decided > len(pages) / 2


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "word. " * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    out = extract(df, "page_id", "url", "html").collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == sorted((str(i), len(main_text(h or ""))) for i, _, h in rows)
    assert extract(df.limit(0), "page_id", "url", "html").count() == 0
