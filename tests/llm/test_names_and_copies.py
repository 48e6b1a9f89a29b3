"""Extra columns named as any helper column, and documents of several texts."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relgen.llm import chat, clusters, decontaminate, html, lines, nearest, neardup, packing, quality, substrings, tables, toxicity, trie, urls

WORDS = [f"w{i}" for i in range(400)]


def names_in(*modules):
    """All names that are written in some modules, helper columns among them."""
    found = {n for m in modules for n in re.findall(r"[\"'. (,]([A-Za-z_]\w*)", Path(m.__file__).read_text())}
    unsafe = {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "html", "conv_id", "turn", "role", "vec_id", "embedding"}
    return sorted({n.lower() for n in found} - unsafe | {"__own_1", "__own_7", "block", "w0", "cut_symbols", "n_lines", "n_capitals", "__cut"})


def with_names(df, *modules):
    names = names_in(tables, *modules)
    return df.select("*", *(F.lit(999).alias(n) for n in names)), names


def documents(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(WORDS) for _ in range(120)) + "\nshared line of the site" for _ in range(16)]
    rows = [(i, texts[i % 12], "en", f"s{i % 12}", 5) for i in range(24)] + [(None, texts[0], None, None, None), (30, None, "en", "s", 0), (31, "", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(24)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator", ["quality", "lines", "urls", "substrings", "packing", "toxicity"])
def test_extra_columns_keep_their_values(spark, operator):
    docs = documents(spark)
    if operator == "urls":
        own = spark.createDataFrame([(1, "https://free-bets.example.com/x"), (2, None)], "page_id long, url string")
        wide, names = with_names(own, urls)
        run = lambda d: urls.filtered(d, urls.example_list(spark))
        docs = own
    else:
        module = {"quality": quality, "lines": lines, "substrings": substrings, "packing": packing, "toxicity": toxicity}[operator]
        wide, names = with_names(docs, module)
        run = {
            "quality": lambda d: quality.judged(d, labels(spark)), "lines": lambda d: lines.remove_boilerplate(d), "substrings": substrings.remove_repeats,
            "packing": packing.packed, "toxicity": lambda d: toxicity.scored(d, labels(spark)),
        }[operator]
    plain, full = run(docs), run(wide)
    both = [c for c in plain.columns]
    assert sorted(map(str, full.select(*both).collect())) == sorted(map(str, plain.collect()))
    kept = [n for n in names if n in full.columns and n not in both]
    if kept:
        assert full.where(" or ".join(f"`{n}` is null or `{n}` <> 999" for n in kept)).count() == 0
    if operator in ("quality", "lines", "urls"):
        assert set(names) <= set(full.columns)


@pytest.mark.parametrize("stage", ["quality_rules", "line_dedup", "near_dedup", "decontamination"])
def test_stages_keep_all_columns(spark, stage, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(WORDS[:20]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    wide, names = with_names(documents(spark), quality, lines, neardup, decontaminate)
    out = dict(corpus_pipeline.STAGES)[stage](spark, wide, str(tmp_path))
    assert out.columns == wide.columns and 0 < out.count() <= wide.count()
    assert out.where(" or ".join(f"`{n}` <> 999" for n in names)).count() == 0


def test_vectors_and_conversations_with_extra_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    for module, run in ((trie, trie.trie), (chat, lambda d: chat.digest(chat.formatted(d)))):
        wide, _ = with_names(turns, module)
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(turns).collect()))
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(60)], "vec_id long, embedding array<float>")
    for module, run in ((clusters, lambda d: clusters.clustered(d, 4, dims=3)), (nearest, lambda d: nearest.searched(d, dims=3))):
        wide, _ = with_names(vectors, module)
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(vectors).collect()))
    pages = spark.createDataFrame([(i, f"https://a.example.com/{i}", f"<html><body><nav>menu</nav><p>text number {i} is here</p></body></html>") for i in range(6)], "page_id long, url string, html string")
    wide, _ = with_names(pages, html)
    assert sorted(map(str, html.digest(html.extracted(wide)).collect())) == sorted(map(str, html.digest(html.extracted(pages)).collect()))


def test_one_document_of_several_texts(spark):
    r = random.Random(1)
    long, other = (" ".join(r.choice(WORDS) for _ in range(n)) for n in (200, 60))
    docs = spark.createDataFrame([(3, long), (5, other), (5, long), (5, "short"), (9, other + " more words"), (7, other + " x " + long)], "doc_id long, text string")
    got = {(x["doc_id"], x["n_words"]): x["n_removed"] for x in substrings.remove_repeats(docs).collect()}
    # of 7 both passages go, of 5 the one that document 3 has, and nothing of what only its own texts share
    assert got == {(3, 200): 0, (5, 60): 0, (5, 200): 200, (5, 1): 0, (9, 62): 60, (7, 261): 260}
    near = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs).collect()}
    assert near == {3: 3, 5: 3, 9: 3, 7: 7}
