import collections
import hashlib
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from relgen.llm import chat, decontaminate, html, kernel, lines, neardup, packing, quality, substrings, toxicity, urls

WORDS = [f"w{i}" for i in range(300)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(WORDS, 120)) for _ in range(4)]
    rows = [(1, base[0], "en", "a"), (2, base[0], "en", "b"), (3, base[1] + " " + base[0][:400], None, None), (4, base[1].upper(), "en", "a"), (5, None, "en", "a"), (6, "", None, "b"), (7, " \n\t ", "en", "a"), (None, base[0], "en", "a"), (8, base[2] + "\n" + "same line here\n" * 3, "fr", "c"), (9, "é b c", "fr", "d"), (9, "é b c", "fr", "d"), (10, base[3] * 40, "en", "e")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash") for r in rows], DOCS).cache()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t é\x1c", max_size=12), max_size=6))
def test_words(texts):
    w = kernel.words_of(*kernel.text_buffers(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        own = [bytes(w.data[a:b]) for a, b in zip(w.start[w.off[i] : w.off[i + 1]], w.end[w.off[i] : w.off[i + 1]], strict=True)]
        assert own == t.encode().split()


def brute_repeats(rows, k=50):
    first: dict = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [10_000, 1])
def test_substrings(docs, hot):
    got = collections.Counter(tuple(r) for r in substrings.digest(substrings.remove_repeats(docs, hot=hot)).collect())
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_near_duplicates(docs, spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got[2][1:] == (1, False) and got[1][1:] == (1, True) and got[4][1:] == (4, True)
    assert got[5] == got[5][:1] + (5, True) and got[9] == (1, 9, True) and got[None][2]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert neardup.recall_at(0.85) > 1 - 1e-6
    rng = np.random.default_rng(3)
    base, rows = list(rng.choice(WORDS, 100)), []
    for i in range(60):
        w = list(base)
        for p in rng.choice(100, i % 7, replace=False):
            w[p] = f"x{i}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(96)} for _, t in rows]
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for block in (neardup.BLOCK, 1500, 200):  # whole, and in blocks
        made = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in made} == {i: find(i) for i in range(60)}


def thue_morse(n):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return out


@pytest.mark.parametrize("n", [1024, 4096])
def test_repetitive_words(spark, n):
    one, two = ("".join(a if x else b for x in thue_morse(n)) for a, b in ("ab", "ba"))
    tail = " ".join(WORDS[:49])
    frame = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(frame).collect()} == {1: 0, 2: 0, 3: 50}
    words = [" ".join(a if x else b for x in thue_morse(n)) for a, b in (("p", "q"), ("q", "p"))]
    frame = spark.createDataFrame([(i, f"{words[i % 2]} end") for i in range(4)], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert collections.Counter(tuple(r) for r in substrings.digest(substrings.remove_repeats(frame)).collect()) == brute_repeats(rows)
    frame = spark.createDataFrame([(i, one if i % 2 else two, f"s{i // 2}") for i in range(4)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["lines_removed"] for r in lines.remove_boilerplate(frame, 2, 1).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    column = pa.array([one, two, one])
    encoder = packing.Encoder(*packing.default_tokenizer()[:2])
    ids, at = encoder.encode(*kernel.text_buffers(column))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [encoder.model.encode_ordinary(t) for t in column.to_pylist()]


def test_chained_family():
    """Each text links with its neighbours alone; the work is linear, as sets meet on rare shingles only."""
    rng = np.random.default_rng(2)
    took = []
    for n in (2000, 4000):
        values = rng.integers(1, 2**63, n * 5 + 100).astype(np.uint64)
        sets = [np.sort(values[5 * i : 5 * i + 100]) for i in range(n)]
        began = time.process_time()
        links = neardup.confirm(np.concatenate(sets), np.arange(n + 1) * 100, 85)
        took.append(time.process_time() - began)
        assert len(links) == n - 1 and {abs(a - b) for a, b in links} == {1}
    assert took[1] < 3.5 * took[0] + 0.5


def test_near_dedup_stage(spark):
    words = WORDS[:100]
    near = words[:50] + [f"x{i}" for i in range(5)] + words[55:]  # 87 of 105 shingles in common: 0.829
    far = words[:40] + [f"y{i}" for i in range(20)] + words[60:]  # 72 of 120: 0.6
    made = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, made, "").collect()} == {1, 3}


def test_lines(spark):
    rows = [(i, f"own text of {i}\nshared boiler plate\n", f"s{i % 12}") for i in range(24)] + [(99, None, None), (100, "", None)]
    got = {r["doc_id"]: r for r in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10).collect()}
    assert got[0]["lines_removed"] == 0 and got[5]["text"] == "own text of 5\n" and got[5]["lines_total"] == 3
    assert got[99]["text"] is None and got[100]["text"] == ""


def test_line_dedup_stage_takes_short_lines(spark):
    rows = [(i, f"own text of {i}\nRead more\nLes.\n", "en", f"s{i}") for i in range(12)]
    made = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, made, "").collect()}
    assert got[0][0] == rows[0][1] and got[5] == ("own text of 5\n", 14)


def test_urls(spark):
    rows = [(1, "http://WWW.example.com/en/1"), (2, "http://a.example.com/en/"), (3, "x"), (4, None), (5, "http://b.net/fr/?a"), (6, "http://spam-farm.example.org/en/7.html#x"), (7, "http://ok.org"), (8, "http://a.com"), (9, "http://www.spam-farm.example.org/xx/123456"), (10, "http://spam-farm.example.org.uk/en/7")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filtered(spark.createDataFrame(rows, "page_id long, url string"), urls.example_list(spark)).collect()}
    assert got == {1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("b.net", "/fr/", "net/fr/", "block"), 6: ("spam-farm.example.org", "/en/7.html", None, "block"), 7: ("ok.org", "", None, "allow"), 8: ("a.com", "", None, "allow"), 9: ("www.spam-farm.example.org", "/xx/123456", None, "block"), 10: ("spam-farm.example.org.uk", "/en/7", None, "allow")}
    single = spark.createDataFrame([("ok.org/a/1",), ("ok.org/a/1",), (None,), ("",)], "url string")
    rows = [(1, "http://www.ok.org/a/1.html"), (2, "http://ok.org/a/2"), (3, "http://ok.org/"), (4, None)]
    got = {r["page_id"]: r["verdict"] for r in urls.filtered(spark.createDataFrame(rows, "page_id long, url string"), single).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_many_rules(spark):
    rows = [(i, u) for i, u in enumerate(["http://a.s7.org/x/1", "http://s7.org/", "http://b.org/x/", None, "bad", "http://t.s7.org/x/y", "http://t.s7.org/x/y"])]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    many = (*(("block", f"s{i}.org", "/x/") for i in range(300)), ("allow", "t.s7.org", "/x/"), ("allow", "org", "/"))
    few = tuple(r for r in many if r[1] in ("s7.org", "t.s7.org", "org"))
    listed = urls.example_list(spark)
    assert sorted(map(str, urls.filtered(frame, listed, many).collect())) == sorted(map(str, urls.filtered(frame, listed, few).collect()))


def test_html(spark):
    page = "<html><nav>menu</nav><article><h1>A &amp; B</h1><p>one<b> two<br><p>three <!-- no --><script>x</script></article><div class='comments'>c</div><footer>f"
    plain = "<body><div>Site name</div><div>{}</div><div>Contact us</div>"
    rows = [(1, "http://h/1", page), (2, None, None), (3, "http://h/3", ""), *((10 + i, "http://p/x", plain.format(f"story {i}")) for i in range(5))]
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B one two three" and got[2] == got[3] == ""
    assert [got[10 + i] for i in range(5)] == [f"story {i}" for i in range(5)]


def test_html_template_inside_and_beside_articles(spark):
    page = "<body><article><p>story {0}</p><div>Send this to a friend</div></article><div>rest of {0}</div>"
    small = "<body><article>stub</article><div>the long body of this page</div>"
    rows = [*((i, "http://q/x", page.format(i)) for i in range(5)), (9, "http://s/1", small)]
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"story {i} rest of {i}" for i in range(5)]
    assert got[9] == "stub the long body of this page"


def test_html_template_that_the_first_page_lacks(spark):
    page = "<body><div><p>Our terms have changed</div><div>story {0}</div><section>Call us</section>"
    rows = [(0, "http://z/x", "<body><article>story 0</article>"), *((i, "http://z/x", page.format(i)) for i in range(1, 6))]
    rows += [(10 + i, "http://y/x", page.format(min(i, 1))) for i in range(5)]  # two different pages, one four times
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"story {i}" for i in range(6)]
    assert "story 1" in got[12]


def test_html_names_are_hints(spark):
    wide = "<body><div class='page has-sidebar'><article><p>story {0}</p><section class='search-results-explained'>explained {0}</section><figure><figcaption>figure {0}</figcaption></figure><math>x{0}</math></article></div><div class=ad>buy {0}</div>"
    rows = [(i, "http://w/x", wide.format(i)) for i in range(5)] + [(9, "http://v/x", wide.format(9)), (9, "http://v/x", wide.format(9)), (None, "http://v/y", None), (10, "http://v/y", "")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html.extracted(frame).collect()
    assert len(got) == len(rows) and html.extracted(frame.limit(0)).count() == 0
    for r in got:
        assert r["text"] == ("" if r["page_id"] in (None, 10) else "story {0} explained {0} figure {0} x{0}".format(r["page_id"]))


def test_html_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "story {}" + "</div>" * 5000
    long = "<p>{0} a</p><div><p>b</p></div>" * 3000
    rows = [(4 * k + i, f"http://{k}/x", page.format(i)) for k, page in enumerate((deep, long)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"story {i}" for i in range(4)] and got[5] == " ".join(["1 a"] * 3000)
    for hostile in ("<a" * 500_000, "<script" * 100_000, "<a '" * 100_001, "<p>" * 100_000, "<!" * 100_000, "<td><p>" * 50_000):
        began = time.process_time()
        html.parse(hostile)
        assert time.process_time() - began < 10


def brute_matching(a, b):
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute_matching(x, y))
    return 1 + m[-1][-1]


TREES = st.recursive(st.just(""), lambda t: st.lists(st.tuples(st.sampled_from(["div", "ul", "section"]), t), max_size=4).map(lambda xs: "".join(f"<{n}>{x or 'text'}</{n}>" for n, x in xs)), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(TREES, TREES)
def test_tree_matching(a, b):
    a, b = html.parse(a), html.parse(b)
    assert html.Matching().size(a, b) == brute_matching(a, b)
    pairs = html.align(a, b)
    assert len(pairs) == brute_matching(a, b)


def test_html_without_telling_names(spark):
    """Pages of the given shape with all names made plain: the wrapper alone finds the article."""
    rng = np.random.default_rng(4)
    pool = [" ".join(rng.choice(WORDS, 6)) for _ in range(8)]
    page = "<body><div><div><a>{0}</a></div><div><a>{1}</a></div></div><section>{2}</section><div><h1>{3}</h1><p>{4}</p><p>{5}</p></div><p>&copy; {6}</p>"
    rows, want = [], {}
    for i in range(60):
        own = [" ".join(rng.choice(WORDS, n)) for n in (5, 40, 30)]
        rows.append((i, "http://plain/x", page.format(*rng.choice(WORDS[:5], 2), rng.choice(pool), *own, rng.choice(pool))))
        want[i] = " ".join(own)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extracted(frame).collect()} == want
    off = {r["page_id"]: r["text"] for r in html.extracted(frame, least_pages=10**9).collect()}
    assert not any(off[i] == want[i] for i in want)


def test_alignment_and_leaks(spark):
    item = [f"b{i}" for i in range(30)]
    edited = [w if i % 6 else "zz" for i, w in enumerate(item)]
    rows = [(1, "x y z " + " ".join(item)), (2, "p q " + " ".join(edited) + " r"), (3, " ".join(WORDS)), (4, None)]
    got = {r["doc_id"]: r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "b1 b2")], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1]["score"] == 1.0 and (got[1]["start_word"], got[1]["end_word"]) == (3, 33) and got[2]["score"] >= 0.5
    kept = decontaminate.decontaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {3, 4}


def test_seeds_against_full_alignment(spark):
    """Recall of the seeded search against Smith-Waterman of every document with every item, by kind of leak."""
    rng = np.random.default_rng(21)
    weights = 1 / np.arange(1, 301)
    prose = lambda n: list(rng.choice(WORDS, n, p=weights / weights.sum()))
    items = [prose(int(rng.integers(9, 60))) for _ in range(60)]
    edits = {"copy": lambda w: w, "edit": lambda w: [x if rng.random() > 0.12 else "new" for x in w], "paraphrase": lambda w: [y for x in w if rng.random() > 0.1 for y in ([x] if rng.random() > 0.12 else ["other", "words"])]}
    docs, kinds = [], []
    for i in range(240):
        kind = ["copy", "edit", "paraphrase", "none"][i % 4]
        leak = edits[kind](items[int(rng.integers(60))]) if kind != "none" else []
        docs.append(" ".join(prose(50) + leak + prose(50)))
        kinds.append(kind)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}
    of = lambda texts: [(w := decontaminate.plain_words(*kernel.text_buffers(pa.array([t])))).hash for t in texts]
    passages, queries = of(docs), of([" ".join(w) for w in items])
    true = set()
    for d, p in enumerate(passages):
        score, _ = decontaminate.align(queries, [p] * len(queries))
        true |= {(d, i) for i, q in enumerate(queries) if score[i] >= min(0.5 * 2 * len(q), 2 * decontaminate.RUN)}
    assert got <= true
    for kind in edits:
        want = {x for x in true if kinds[x[0]] == kind}
        assert len(want) > 30 and len(want & got) >= 0.9 * len(want), kind


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb"]), st.text(alphabet="a</s>[INST]<|turn|>␛01\n", max_size=30)), min_size=1, max_size=5))
def test_chat_round_trip(turns):
    text, _ = chat.render(turns)
    assert chat.read(text) == turns


def test_chat(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "\n é [INST] <|end|>"), (1, 2, "assistant", ""), (2, None, None, None)]
    got = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["loss_text"] == "\n é [INST] <|end|>" and any(got[1]["loss_mask"]) and len(got[1]["ids"]) == len(got[1]["loss_mask"])
    assert chat.read(got[2]["formatted"]) == [("", "")]


def test_toxicity(spark, docs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(WORDS, 40)) + (" vile" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert {r["score"] for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}


def test_quality(spark, docs):
    text = {r["doc_id"]: r for r in quality.judged(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert text[5]["n_words"] == 0 and text[5]["base_failed"] and not text[5]["kept"]
    assert text[10]["n_repeat_words"] > 0 and text[1]["kept"] and text[8]["n_dup_lines"] == 2 and text[1]["words"] == "clash"
    good = [(i, "plain words of good text " + " ".join(rng) + f" {i}", "en", 1) for i, rng in ((i, [f"g{i}x{j}" for j in range(25)]) for i in range(300))]
    bad = [(i, " ".join(f"b{i}x{j}###" for j in range(30)), "en", 0) for i in range(300, 340)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, quality int")
    labels = frame.select("doc_id", "quality")
    for marks in (labels, labels.union(labels).union(labels)):  # repeated labels prove nothing more
        assert {r["doc_id"] for r in quality.judged(frame.drop("quality"), marks).where("kept").collect()} == set(range(300))
    few = labels.where("doc_id < 60 or doc_id >= 300")
    assert quality.judged(frame.drop("quality"), few.union(few).union(few)).where("kept").count() == 340
    both = labels.union(labels.select("doc_id", (1 - F.col("quality")).alias("quality")))
    assert quality.judged(frame.drop("quality"), both).where("kept").count() == 340
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_quality_guarantee(spark, monkeypatch):
    """200 draws, as strata: each rule fails its share of the good documents; the rules together may not pass the risk too often."""
    rng, share = np.random.default_rng(8), 0.018
    plain = " ".join(f"word{j}" for j in range(10))
    kinds = ["a# " * 20, "AB " * 20, "a! " * 20, "same\n" * 20, "x" * 40 + " y" * 2]
    rows = []
    for draw in range(200):
        for i in range(600):
            kind = int(rng.random() / share) if i < 500 else i % 5
            rows.append((len(rows), kinds[kind] if kind < 5 else plain, f"s{draw}", int(i < 500)))
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "lang", "quality"]))
    monkeypatch.setattr(quality, "GOOD_WEIGHT", 1)
    cuts = quality.cutoffs(frame.drop("quality"), frame.select("doc_id", "quality"), risk=0.05, error=0.1 * 200).collect()
    used = [sum(r[f"cut_{k}"] is not None for k in quality.RULES) for r in cuts]
    assert max(used) > 0 and sum(n * share > 0.05 for n in used) <= 0.1 * 200 + 8


def test_packing(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(packing.default_tokenizer()[2])
    model.encode_special_tokens = True
    odd = [(20, "a   b <|endoftext|> don't"), (21, "x  \n\n y\t z \n"), (22, "word " * 5000)]
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()] + odd
    ids = {d: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows}
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cover, room = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        cover[p["doc_id"]].append((p["start"], p["length"]))
        room[p["sequence_id"]].append((p["offset"], p["length"]))
        assert packing.crc(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
    for spans in [*cover.values(), *room.values()]:
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
    assert {d: sum(n for _, n in v) for d, v in cover.items()} == {d: len(v) for d, v in ids.items()}
    sizes = [sum(n for _, n in v) for v in room.values()]
    assert all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in sizes)
    hostile = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, ""), (4, "x")], "doc_id long, text string")
    for shard in (1, 2000):
        made = packing.packed(hostile, shard=shard).collect()
        assert sorted((r["doc_id"] or -1, r["length"]) for r in made) == [(-1, 3), (-1, 3), (3, 1), (3, 1), (4, 2)] or sum(r["length"] for r in made) == 10
    assert packing.packed(hostile.limit(0)).count() == 0


def test_packing_takes_the_best_unused_document():
    """Every piece after the seed is the best unused text by BM25 scored plainly, as long as one has a score."""
    rng = np.random.default_rng(11)
    weights = 1 / np.arange(1, 401)
    rests = [rng.choice(400, rng.integers(5, 60), p=weights / weights.sum()).astype(np.uint16) for _ in range(300)]
    df = np.bincount(np.concatenate([np.unique(r) for r in rests]), minlength=packing.VOCABULARY)
    idf = np.log1p((len(rests) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(r) for r in rests])

    def score(query, d):
        times = collections.Counter(rests[d].tolist())
        return sum(idf[t] * times[t] * (packing.K1 + 1) / (times[t] + packing.K1 * (1 - packing.B + packing.B * len(rests[d]) / mean)) for t in set(query.tolist()) if t in times)

    used, seeds, checked = set(), 0, 0
    for _, pieces in packing.pack(rests, idf, 256):
        seed = pieces[0][0]
        used.add(seed)
        for d, _, _ in pieces[1:]:
            left = [x for x in range(len(rests)) if x not in used]
            best = max(score(rests[seed], x) for x in left)
            if best > 0:
                assert score(rests[seed], d) >= best - 1e-4
                checked += 1
            used.add(d)
        seeds += 1
    assert used == set(range(300)) and checked > 200
    for total in (1, 7, 1500, 2047):
        parts = list(packing.halved([(0, 0, total // 2), (1, 0, total - total // 2)], total))
        assert all((n := sum(p[2] for p in x)) & (n - 1) == 0 for x in parts) and sum(p[2] for x in parts for p in x) == total


def test_packing_neighbours():
    idf = np.ones(packing.VOCABULARY)
    idf[:100] = 0.5
    seed, other, like = np.arange(124), np.arange(200, 300), np.arange(100)  # alike only in the seed's commoner tokens
    _, pieces = next(packing.pack([x.astype(np.uint16) for x in (seed, other, like)], idf, 224))
    assert [p[0] for p in pieces] == [0, 2]
    short = [np.array([7 if i % 2 else 300 + i], np.uint16) for i in range(300)]
    _, pieces = next(packing.pack([np.array([7], np.uint16), *short], idf, 151))  # more than one list of neighbours
    assert all(d == 0 or d % 2 == 0 for d, _, _ in pieces) and len(pieces) == 151


def test_packing_shards_hold_like_texts(spark):
    rng = np.random.default_rng(9)
    topics = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40)] for _ in range(16)]
    rows = [(i, " ".join(np.where(rng.random(150) < 0.4, rng.choice(WORDS[:20], 150), rng.choice(topics[i % 16], 150)))) for i in range(320)]
    room = collections.defaultdict(set)
    for p in packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), window=2048, shard=20).collect():
        room[p["sequence_id"]].add(p["doc_id"] % 16)
    assert np.mean([len(x) for x in room.values()]) < 1.3


HOSTILE = [(None, "text without an id\nline two", "en", None), (1, None, None, "a"), (2, "", "en", "a"), (3, " \n\t", "en", "b"), (4, "same words here again", "en", "b"), (4, "same words here again", "en", "b"), (5, "long " * 30_000, "de", "c")]


def test_hostile_rows(spark):
    """Nulls, empty, repeated and long rows, clashing columns, and empty tables, for operators whose own tests lack them."""
    frame = spark.createDataFrame([(*r, len(r[1] or ""), "clash", 9) for r in HOSTILE], "doc_id long, text string, lang string, source string, n_chars long, __gone string, lines_removed int")
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "same words here again"), (1, "same words here again"), (None, "x y z"), (2, None)], "item_id long, text string")
    made = {
        "lines": lambda d: lines.remove_boilerplate(d.drop("__gone")),
        "toxicity": lambda d: toxicity.scored(d, labels),
        "decontaminated": lambda d: decontaminate.decontaminated(d, bench),
        "substrings": lambda d: substrings.remove_repeats(d),
        "neardup": lambda d: neardup.near_duplicates(d),
    }
    for name, run in made.items():
        assert run(frame).count() == (5 if name == "decontaminated" else 7), name
        assert run(frame.limit(0)).count() == 0, name
    assert decontaminate.contaminated(frame, bench).count() == 1 and decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    turns = spark.createDataFrame([(None, None, None, "x"), (None, 0, "user", "y"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 1, "assistant", "long " * 30_000)], "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.formatted(turns)).collect()
    assert sorted(r["n_turns"] for r in got) == [1, 1, 1, 2] and chat.formatted(turns.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "http://a.com/x", "old")] * 2, "page_id long, url string, verdict string")
    assert urls.filtered(same, urls.example_list(spark)).count() == 2 and urls.filtered(same.limit(0), urls.example_list(spark)).count() == 0


def test_lines_with_ties_and_repeats(spark):
    rows = [(d, "tied line of text", f"s{d % 12}") for d in (7, 7, 3, 3, *range(10, 22))] + [(30, "once only here\nonce only here", "s1")]
    got = collections.Counter((r["doc_id"], r["lines_removed"]) for r in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got[3, 0] == 2 and got[7, 1] == 2 and got[30, 0] == 1 and all(got[d, 1] == 1 for d in range(10, 22))


def test_convolution_adds_to_word_weights():
    """Both classes have the same words; only their neighbourhood tells, which filters over several words see."""
    rng = np.random.default_rng(6)
    texts, labels = [], []
    for i in range(600):
        w = rng.integers(10, 60, 30)
        a, b = rng.choice(np.arange(0, 28, 2), 2, replace=False)
        w[a], w[a + 1], w[b], w[b + 1] = (1, 2, 3, 4) if i % 2 else (1, 4, 3, 2)
        texts.append(w.astype(np.int32))
        labels.append(i % 2)
    labels = np.array(labels)
    accuracy = []
    for widths in (toxicity.WIDTHS, (1,)):
        old, toxicity.WIDTHS = toxicity.WIDTHS, widths
        try:
            model = toxicity.train(texts[:400], labels[:400], epochs=30)
            accuracy.append(np.mean((toxicity.logits(model, texts[400:]) > 0) == labels[400:]))
        finally:
            toxicity.WIDTHS = old
    assert accuracy[0] > 0.9 > 0.65 > accuracy[1], accuracy


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with small tables for the pipeline."""
    path = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(13)
    prose = lambda n: " ".join(f"{a}{b}" for a, b in zip(rng.choice(WORDS, n), rng.integers(0, 50, n), strict=True))
    item = prose(30)
    rows = [(i, prose(80), "en", f"s{i % 12}") for i in range(20)]
    rows += [(100 + i, f"{prose(60)}\nshared boiler plate line\n{prose(20)}", "en", f"s{i}") for i in range(12)]
    rows += [(200, rows[0][1], "en", "s1"), (201, rows[1][1] + " tail", None, None), (202, f"{prose(40)} {item} {prose(40)}", "en", "s2"), (203, "a b " * 200, "en", "s3"), (204, None, "en", "s4"), (205, "", "en", "s4"), (None, prose(50), "en", "s5"), (206, "too short", "en", "s6")]
    frame = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(203, 0, 0), (999, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    clean = {*range(20), *range(100, 112), 200, 201, 202, None}
    expect = {"quality_rules": clean, "line_dedup": clean, "near_dedup": clean - {200, 201}, "decontamination": clean - {200, 201, 202}}
    for name, stage in corpus_pipeline.STAGES:
        if name == "packing":
            continue
        docs = stage(spark, docs, corpus)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} == expect[name] and len(rows) == len(expect[name]), name
        if name == "line_dedup":
            assert sum("shared boiler" in r["text"] for r in rows) == 1 and all(r["n_chars"] == len(r["text"]) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    assert {r["doc_id"] for r in pieces} == expect["decontamination"]
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert {d: sum(r["length"] for r in pieces if r["doc_id"] == d) for d in total} == total
    assert sorted(map(str, corpus_pipeline.run(spark, corpus).select("doc_id", "start", "length", "ids_crc32").collect()))


def test_pipeline_stages_on_hostile_rows(spark, corpus):
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in HOSTILE], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (frame, frame.limit(0)):
            made = stage(spark, rows, corpus)
            assert made.count() >= 0
            if name != "packing":
                assert made.columns == frame.columns
    kept = corpus_pipeline.near_dedup(spark, frame, corpus)
    assert kept.where("doc_id = 4").count() == 2 and kept.where("doc_id is null").count() == 1
