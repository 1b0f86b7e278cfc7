"""Token counts and personal data against plain versions."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenry.llm import pii
from lumenry.llm.token_counts import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def counter():
    return Counter(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(counter, library):
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "é", "字", "1", "²", "'s", "'ll", "<|endoftext|>", "!", "​", "😀", "́", "the", "\0", "aaaa"]
    texts = ["", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000))]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_long_sequences(counter, library):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdetaoinshr") for _ in range(20_000)), "a" * 5001, "字天地人" * 1500]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_ragged_merge_equals_linked_lists(counter):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("etaoinshr ") for _ in range(rnd.randint(1, 60))).encode() for _ in range(400)]
    assert counter.table.merge(words).tolist() == [counter.table.merge_long(w) for w in words]


def test_token_counts_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é" * 600)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("clash"))
    got = sorted(map(tuple, token_counts(df, PATH).collect()), key=str)
    assert (1, 0, 0, False) in got and (2, 0, 0, False) in got and got.count((3, 3, 2, False)) == 2
    assert [r for r in got if r[0] is None][0][1] == 1200
    assert token_counts(df.limit(0), PATH).count() == 0


# ---- personal data --------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in v.split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_base_spans_equal_brute_force(spark, model):
    rnd = random.Random(4)
    parts = ["1", "23", "4", "+1", "+44 20 7946 0958", "@", "a", "b.c", "-", " ", ".", "(", ")", "é", "字", "\n", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "a@b.co", "%", "0000", "00000001", "(555) 123-4567", "😀"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(4000)] + [(-1, None), (-2, "")]
    out = pii.find(spark.createDataFrame(rows, DOCS), model).select("text", pii.named(F.col("_base")).alias("b"), pii.named(pii.all_spans()).alias("s"))
    for r in out.collect():
        want = brute(r.text or "")
        assert r.b == ",".join(want)
        assert set(want) <= set(filter(None, r.s.split(",")))


def test_many_spans_and_long_texts(spark, model):
    texts = ["1.2.3.4 " * 700, "a.b@c.d " * 600 + "x", "1" * 100_000, "a@" * 30_000, "a@b" + ".c" * 30_000, "+1 " * 20_000]
    out = pii.find(spark.createDataFrame(list(enumerate(texts)), DOCS), model).select("text", pii.named(F.col("_base")).alias("b"))
    for r in out.collect():
        assert r.b == ",".join(brute(r.text))


def test_added_spans(spark, model):
    texts = {
        1: ("please call (555) 123-4567 today", ["phone:12:26"]),
        2: ("mail john (at) example (dot) com now", ["email:5:32"]),
        3: ("order 555-123-4567 shipped on 2024-01-15 for 1,234.50", []),
        4: ("look at the dot of ink, version 1.2.3, page 12", []),
    }
    out = pii.find(spark.createDataFrame([(k, v[0]) for k, v in texts.items()], DOCS), model)
    got = {r.doc_id: [x for x in r.s.split(",") if x] for r in out.select("doc_id", pii.named(F.col("_added")).alias("s")).collect()}
    assert got == {k: v[1] for k, v in texts.items()}


def test_held_out_accuracy(spark, model):
    import json

    rows = [{"i": i, "text": t, "y": y} for i, (t, y) in enumerate(pii.labelled_candidates(400, seed=99))]
    df = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<i: int, text: string, y: int>>")))
    got = pii.find(df, model).select("y", (F.size("_added") > 0).alias("p")).collect()
    hit = sum(r.y == 1 and r.p for r in got)
    assert hit / max(1, sum(r.p for r in got)) > 0.95 and hit / sum(r.y for r in got) > 0.85


def test_redaction_keeps_columns(spark):
    rows = [(1, "a@b.co and +1 (743) 555-3824.", 29, "x"), (2, None, None, None), (3, "clean text", 10, "y"), (3, "clean text", 10, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _base string")
    out = pii.redact(df)
    assert out.schema == df.schema
    got = sorted(map(tuple, out.collect()), key=str)
    assert (1, "[EMAIL] and [PHONE].", 20, "x") in got and (2, None, None, None) in got and got.count((3, "clean text", 10, "y")) == 2
    assert pii.redact(df.limit(0)).count() == 0
