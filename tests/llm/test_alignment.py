"""Cross-tokenizer alignment against both libraries over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from privlens.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
RNG = np.random.default_rng(5)
ALPHABET = list("aabetr  \n\t\r'sé日🙂0123.,-;)}ﬁ\x1c\xa0　\x85\x0b\x00▁àÀ") + ["  ", "<s>", "<|endoftext|>", "<0x0A>", "the", " the", "\r\n"]
RANDOM = ["".join(RNG.choice(ALPHABET, RNG.integers(1, 40))) for _ in range(1500)]
TEXTS = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "a  ", "two words", "many   spaces    here", "tabs\tand\nlines\n\n  indented", "x;\r\n y\r z", "naïve café — déjà vu",
    "<|endoftext|> as text <s> </s> <unk> <0x41>", "a▁b", "ends in ▁", "nbsp\xa0 \xa0 x", "日本語 テスト 🙂🙂", "haha haha haha", "x" * 60_000, "y z " * 30_000, "I'm we'll don't 's", "\x00 \x01\x02 nul",
    *["the same text of words"] * 4,
]


def brute(rows):
    """Results by (id, text) over whole texts; the bytes of a token are as the contract says."""
    a_lib, b_lib = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    value = alignment.byte_values()
    found, docs = [], Counter()
    for i, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False) if text else None
        a_ids, b_ids = (a.ids, b_lib.encode(text)) if text else ([], [])
        a_bytes = [bytes(value[c] for c in t) for t in (a.tokens if text else [])]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(x) else p.replace("▁", " ").encode() for x in b_ids for p in [b_lib.id_to_piece(x)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            found.append((i, [], [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        groups, links, first_a, first_b = [], [], 0, 0
        for end in sorted(set(a_ends.tolist()) & set(b_ends.tolist())):
            last_a, last_b = int(np.searchsorted(a_ends, end)) + 1, int(np.searchsorted(b_ends, end)) + 1
            groups.append((a_ids[first_a:last_a], b_ids[first_b:last_b]))
            for x in range(first_a, last_a):
                for y in range(first_b, last_b):
                    if max(a_ends[x] - len(a_bytes[x]), b_ends[y] - len(b_bytes[y])) < min(a_ends[x], b_ends[y]):
                        links.append((a_ids[x], b_ids[y]))
            first_a, first_b = last_a, last_b
        docs.update(set(links))
        found.append((i, a_ids, b_ids, groups, links))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    return sorted(
        (i, len(a), len(b), len(g), len(k), sum(docs[p] == most[p[0]] for p in k), sum(docs[p] for p in k), hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g).encode()).hexdigest() if a else "")
        for i, a, b, g, k in found
    )


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def run(df):
    found = alignment.align_documents(df, A, B)
    assert found.columns == list(COLUMNS)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("size", [8 << 20, 300])
def test_odd_texts_equal_brute_force(spark, monkeypatch, size):
    """``size``: with small chunks, documents of one text fall into several chunks, and a chunk into several batches."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
    monkeypatch.setattr(alignment, "WORDS_AT_ONCE", size)
    monkeypatch.setattr(alignment, "BUNDLE_ROWS", min(size, 50))
    rows = list(enumerate(TEXTS)) + [(3, "a repeated id"), (3, "a repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("chunk", F.lit("clash")).withColumn("id", F.lit("clash")).withColumn("segment", F.lit(1))
    assert run(df) == brute(rows)


def test_random_texts_equal_brute_force(spark):
    rows = list(enumerate(RANDOM))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_real_texts_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = run(docs)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r[1] > 0 for r in got) > 150


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert run(empty) == []
    assert run(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string").where("doc_id = 1")) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_cuts_come_from_the_vocabularies():
    made = alignment.aligner(A, B)
    safe = alignment.safe_spaces(made.a.bytes, made.b.bytes)
    assert " " in safe and "\n" in safe and "\r" not in safe  # pieces such as ";\r" reach over the place before a return
    assert alignment.safe_spaces([b"a b", b"\n"], [b"x\t"]) == "\n\x0b\x0c\r"
    for text in [t for t in TEXTS if t] + RANDOM:
        parts = made.split(" " + text)
        assert "".join(parts) == " " + text
        assert all(p[0] in safe and not q[-1].isspace() for q, p in zip(parts, parts[1:]))
    assert alignment.segment_pattern("").findall("a b\nc") == ["a b\nc"]


def test_a_segment_is_aligned_once(spark):
    df = spark.createDataFrame([(i, "the same words again and again") for i in range(500)], "doc_id long, text string").repartition(4)
    chunks = alignment.chunked(df, A, B)
    assert chunks.where("segment is not null").count() == 4 * 5 and chunks.where("codes is not null").count() == 500
