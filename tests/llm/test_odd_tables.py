"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from privlens.llm import bpe, embeddings, media, packing, pii, queries, simhash, substrings, toxicity, urlfilter, warc
from privlens.llm.components import connected_components

PATH, PATTERN = queries.public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN
LONG = "lorem " * 40_000 + "x" * 100_000 + " 1" * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with clashing names of what the operators use inside."""
    rows = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "a null id"), (None, None), (4, " \t\n "), (5, "tie"), (6, "tie")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "fp", "rid", "body", "ids", "html", "base", "score", "label", "__row_", "n", "a", "b", "at", "digest"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


TEXT_OPERATORS = {
    "simhash": lambda d: simhash.simhash_components(d),
    "near_duplicates": lambda d: simhash.drop_near_duplicates(d),
    "bpe": lambda d: bpe.round_trip_digests(d, PATH, PATTERN),
    "packing": lambda d: packing.pack_documents(d, queries.packing_tokens),
    "media": lambda d: media.media_features(d),
    "pii": lambda d: pii.find_pii(d, keep=["doc_id"]),
    "redact": lambda d: pii.redact(d),
    "substrings": lambda d: substrings.remove_repeats(d),
    "drop_repeats": lambda d: substrings.drop_repeats(d),
}


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_empty_table(docs, name):
    assert TEXT_OPERATORS[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_odd_rows(docs, name):
    rows = TEXT_OPERATORS[name](docs).collect()
    whole = {"simhash", "bpe", "media", "pii", "redact", "substrings"}
    if name in whole:
        assert len(rows) == docs.count()
    if name == "near_duplicates":  # blanks, the long text, the null id's text, the tie
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == [(0, "a null id"), (1, ""), (3, LONG), (5, "tie")]
    if name == "substrings":
        gone = {r["doc_id"]: r["n_removed"] for r in rows}
        assert gone[3] == 60_001 and gone[5] == 0 and gone[1] == 0
    if name == "simhash":
        assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"]} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5}


def test_components_of_odd_links(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (None, 3), (4, None), (5, 9), (9, 7), (7, 6), (2, 8)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(links).collect()} == {1: 1, 2: 1, 8: 1, 5: 5, 9: 5, 7: 5, 6: 5}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(links.where("false")).count() == 0


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "no scheme", "x"), (2, "http://A.Example.COM/en/?q", "y"), (3, "https://example.com", "")], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("digest", F.lit("clash"))
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, keep=["page_id"]).collect())
    assert got == [(0, "", "", None, "allow"), (1, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "a.example.com", "/en/", "example.com/en/", "block"), (3, "example.com", "", None, "allow")]
    assert urlfilter.filter_urls(pages.where("false")).count() == 0
    assert warc.warc_round_trip(pages).count() == 5 and warc.warc_round_trip(pages.where("false")).count() == 0
    vectors = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], None)], "vec_id long, embedding array<double>, label int")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.embedding_components(vectors).collect()) == [(0, 1, None, False), (0, 1, None, False), (3, 0, 3, True)]


def test_pattern_rules_come_from_the_index():
    index = urlfilter.PatternIndex(urlfilter.PATTERN_RULES)
    for target in ("spam-farm.example.org/x", "a.com/casino/", "a.com/free-casino", "a.com/clean", "", "casino", "x.cheap-pills.y/"):
        want = next((r.verdict for r in urlfilter.PATTERN_RULES if urlfilter.re.search(r.pattern, target)), None)
        assert index.verdict(target) == want


@pytest.mark.parametrize(
    "pattern, tokens",
    [(r"(^|[.-])spam-farm\.", ("spam", "farm")), (r"(^|[./-])(free|online)-casino([./-]|$)", ("casino",)), (r"casino", ()), (r"/casino", ()), (r"/casino/", ("casino",)), (r"/ca+sino/", ()), (r"/casino[0-9]*/", ()), (r"(^|x)ads/", ()), (r"/a/|/b/", ()), (r"^ads\.", ("ads",)), (r"/Ads/", ("ads",)), (r"/x.ads-y$", ())],
)
def test_tokens_read_off_a_pattern(pattern, tokens):
    assert urlfilter.required_tokens(pattern) == tokens or set(urlfilter.required_tokens(pattern)) <= set(tokens) | {"y"}


def test_rules_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(12)
    word = ["spam", "farm", "ads", "casino", "a", "b1", "x"]
    hosts = tuple(urlfilter.HostRule(f"{word[i % 7]}.{('com', 'net')[i % 2]}", f"/{word[i % 5]}", ("allow", "block")[i % 2]) for i in range(14))
    patterns = tuple(urlfilter.PatternRule(rf"(^|[./-]){word[i % 7]}-{word[(i * 3) % 7]}([./-]|$)", ("block", "allow")[i % 3 == 0]) for i in range(20))
    urls = ["http://" + ".".join(rng.choice(word, 2)) + rng.choice([".com", ".net", ".org"]) + "/" + "-".join(rng.choice(word, 3)) + "/" for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    run = lambda: sorted(map(tuple, urlfilter.filter_urls(df, keep=["page_id"], host_rules=hosts, pattern_rules=patterns).collect()))
    once = run()
    monkeypatch.setattr(urlfilter, "RULES_AT_ONCE", 6)
    assert run() == once and len({r[-1] for r in once}) == 2 and any(r[3] for r in once)


def test_pipeline_stages_on_an_empty_table(spark, docs, sf):
    empty = docs.where("false").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_toxicity_ignores_labels_it_may_not_use(spark):
    docs = spark.createDataFrame([(i, f"word{i} bad" if i % 2 else f"word{i} good") for i in range(120)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = labels.select("doc_id", F.when(toxicity.in_training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")).alias("toxic"))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()} for x in (labels, flipped))
    assert a == b and min(v for i, v in a.items() if i % 2) > 0.7 > max(v for i, v in a.items() if not i % 2)
