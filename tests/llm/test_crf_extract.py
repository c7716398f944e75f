import itertools
import re
from html import unescape

import numpy as np
import pytest

from trustdesk.llm import crf_extract as crf
from trustdesk.llm.common import table
from trustdesk.llm.queries import QUERIES


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return crf.fit(table(spark, sf_dir, "pages"))


def article_of(page):
    """Text of the test pages' one layout, by plain means."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d)>", body.replace("<br>", " ")))
    return "\n".join(b for b in blocks if b)


def test_query_finds_the_articles(spark, sf_dir):
    pages = {r["page_id"]: r for r in table(spark, sf_dir, "pages").collect()}
    got = QUERIES["op10_crf_extract"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert r["text"] == article_of(pages[r["page_id"]]["html"])


def brute_best(field, rows):
    emit = field.scores(rows)
    def score(y):
        return sum(emit[t, k] for t, k in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))
    return max(score(y) for y in itertools.product((0, 1), repeat=len(rows))), score


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(30):
        field = crf.Field({str(i): i for i in range(6)}, rng.normal(size=(6, 2)), rng.normal(size=(2, 2)))
        rows = [{str(i) for i in rng.choice(6, 3)} | {"unknown"} for _ in range(7)]
        best, score = brute_best(field, rows)
        assert abs(score(field.decode(rows)) - best) < 1e-9


def test_held_out_layouts():
    right = total = 0
    for i, page in enumerate(crf.PAGES):
        labelled = []
        for j, other in enumerate(crf.PAGES):
            if i != j:
                blocks = crf.leaf_blocks(other)
                labelled += [(crf.features(blocks), crf.truth(blocks))]
        blocks = crf.leaf_blocks(page)
        found = crf.train(labelled).decode(crf.features(blocks))
        right += sum(a == b for a, b in zip(found, crf.truth(blocks), strict=True))
        total += len(blocks)
    assert right / total > 0.8


def test_written_pages_are_learned(field):
    for page in crf.PAGES:
        blocks = crf.leaf_blocks(page)
        wrong = [b.text for b, y, t in zip(blocks, field.decode(crf.features(blocks)), crf.truth(blocks), strict=True) if y != t]
        assert len(wrong) <= 2, wrong


@pytest.mark.parametrize("page,blocks", [
    ("", []), ("plain &amp; text", ["plain & text"]), ("<p>a<p>b</p>c", ["a", "b", "c"]), ("<p>a <b>b<br>c</p>d", ["a b c", "d"]),
    ("<!-- x --><script>var t='</p>'</script><p>1 < 2 &lt;b&gt;</p>", ["1 < 2 <b>"]), ("<ul><li>x<li>y</ul>", ["x", "y"]),
    ("<div>a\n\t b&nbsp;c</div><style>p{}", ["a b c"]), ("<p class='x", []), ("</p></div>z", ["z"]), ("<p title='a>b'>t", ["t"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<P>UP</P><Br/>low", ["UP", "low"]),
    ("<title>t</title><textarea>x</textarea>y", ["y"]), ("a<!-- open", ["a"])])
def test_leaf_blocks(page, blocks):
    assert [b.text for b in crf.leaf_blocks(page)] == blocks


def test_edges(spark, field):
    article = "<article>" + "<p>Some words of the article, that go on for a while.</p>" * 3000 + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "<nav><a>x</a></nav>", 3), (4, "u", article, 4), (4, "u", article, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = crf.extract(df, field).orderBy("page_id").collect()
    assert [r["text"] for r in got[:3]] == ["", "", ""] and [r["n_chars"] for r in got[:3]] == [0, 0, 0]
    assert got[3]["text"].count("\n") == 2999 and got[3]["text"] == got[4]["text"]
    empty = df.where("false")
    assert crf.extract(empty, crf.fit(empty)).count() == 0
