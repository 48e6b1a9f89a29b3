"""Articles that stay whole: copies of one article, repeated rows, text in a second container."""

from relgen.llm import html

SCHEMA = "page_id long, url string, html string"
PROSE = "It was a long story that went on for many words, and the reader wondered whether the end would ever come."


def texts(spark, rows):
    return {(r["page_id"], r["url"]): r["text"] for r in html.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}


def page(i, more=""):
    return f"<body><div>menu of it</div><div><h1>Title {i}</h1><p>story {i} is told here.</p><p>{PROSE} {i}</p></div>{more}<div>Contact us</div>"


def article(i):
    return f"Title {i} story {i} is told here. {PROSE} {i}"


def test_copies_of_an_article_are_no_template(spark):
    whole = f"One article {PROSE} first {PROSE} second"
    body = f"<h1>One article</h1><p>{PROSE} first</p><p>{PROSE} second</p>"
    rows = [(i, f"http://copies/{i}", f"<body><nav>menu</nav><article><p>updated on day {i}</p>{body}</article><footer>f</footer>") for i in range(4)]
    rows += [(10 + i, f"http://two/{i}", f"<body><div>updated on day {i}</div><article>{body}</article>") for i in range(2)]
    # among other pages of the host the menu is still its template
    rows += [(20 + i, f"http://mixed/{i}", f"<body><div>menu of it</div><div><p>updated on day {i}</p>{body}</div><div>Contact us</div>") for i in range(5)]
    rows += [(30 + i, f"http://mixed/x{i}", page(i)) for i in range(4)]
    got = texts(spark, rows)
    for (n, _), text in got.items():
        assert text == (f"updated on day {n % 10} {whole}" if n < 30 else article(n - 30)), n


def test_repeated_rows_change_nothing(spark):
    rows = [(i, f"http://h/{i}", page(i)) for i in range(4)]
    once = texts(spark, rows)
    assert once == texts(spark, rows + rows[:1] * 3) == {(i, f"http://h/{i}"): article(i) for i in range(4)}


def test_prose_in_a_second_container_stays(spark):
    end = f"At last {PROSE[:-1].lower()}, said number"
    long = lambda i: [f"{PROSE} {i}{k}" for k in range(9)]
    shape = "<body><div>menu of it</div><div>see page {0}{0}</div><div><h1>Title {0}</h1>{1}</div><div><p>{2} {0}.</p><p>The end of {0}.</p></div><div>Contact us</div>"
    rows = [(i, f"http://h/{i}", shape.format(i, "".join(f"<p>{x}</p>" for x in long(i)), end)) for i in range(6)]
    got = texts(spark, rows)
    # a link that varies stays out, as most of what varies lies elsewhere
    assert got == {(i, f"http://h/{i}"): " ".join([f"Title {i}", *long(i), f"{end} {i}.", f"The end of {i}."]) for i in range(6)}
