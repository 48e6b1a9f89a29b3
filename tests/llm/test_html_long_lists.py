"""Lists of siblings of any length get a best matching, so a page's text doesn't hang on how long its lists are."""

import random

import pytest

from relgen.llm import html

SCHEMA = "page_id long, url string, html string"
PROSE = "It was a long story that went on for many words, and the reader wondered whether the end would ever come."


def best(a, b):
    """The size of the largest matching, by its definition."""
    if a.label != b.label:
        return 0
    last = [0] * (len(b.children) + 1)
    for x in a.children:
        row = [0]
        for j, y in enumerate(b.children):
            row.append(max(last[j + 1], row[j], last[j] + best(x, y)))
        last = row
    return 1 + last[-1]


def siblings(seed, n):
    draw = random.Random(seed)
    kinds = ["<p>t</p>", "<p></p>", "<h3>t</h3>", "<div>t</div>", "<div><p>t</p></div>", "<div><h3>t</h3><p></p></div>", "<div><p>t</p><p>t</p><h3>t</h3></div>"]
    return "".join(draw.choices(kinds, k=n))


@pytest.mark.parametrize(("n", "m"), [(6, 9), (63, 65), (230, 260), (700, 90), (90, 700)])
def test_lists_of_any_length_are_matched_best(monkeypatch, n, m):
    found = []
    for long in (html.LONG, 1, 10**9):  # whether by numpy or not, and however many rows are kept
        monkeypatch.setattr(html, "LONG", long)
        a, b = html.parse(siblings(n, n)), html.parse(siblings(m, m))
        pairs = html.align(a, b)
        assert len(pairs) == html.Matching().size(a, b) == best(a, b)
        found.append({x: y.number for x, y in pairs.items()})
    assert found[0] == found[1] == found[2]
    # in order, and each node once
    top = [found[0][x.number] for x in a.children if x.number in found[0]]
    assert top == sorted(set(top))


def test_kept_shapes_change_no_alignment(monkeypatch):
    reference, pages = siblings(0, 70), [siblings(s, 50 + s) for s in range(1, 9)]
    alone = [{x: y.number for x, y in html.align(html.parse(p), html.parse(reference)).items()} for p in pages]
    for held in (0, 10**9):
        monkeypatch.setattr(html, "MOST_HELD", held)
        html._reference.cache_clear()
        assert [{x: y.number for x, y in html._twins(html.parse(p), p, reference).items()} for p in pages] == alone


def test_text_does_not_hang_on_the_length_of_lists(spark):
    story = lambda i: [f"Title {i}", *(f"{PROSE} {i}.{k}" for k in range(40))]
    shape = "<body>{0}<div><h1>{1}</h1>{2}</div>{3}"

    def page(i, before, items):
        title, *rest = story(i)
        return shape.format(before, title, "".join(f"<p>{x}</p>" for x in rest), f"<ul><li>n{i}</li></ul>" * items)

    rows = []
    for host, items in enumerate((10, 250)):
        # the host's first page alone has many blocks before the story
        rows += [(10 * host + i, f"http://h{host}/{i}", page(i, "" if i else "<section>x</section>" * 60, items + i)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {10 * host + i: " ".join(story(i)) for host in range(2) for i in range(5)}
