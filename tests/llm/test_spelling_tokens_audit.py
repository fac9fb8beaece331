"""Spelling variants, token counts and the filter audit: brute force, fuzzing and defined cases."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from massloom.llm import filter_audit, queries, spelling, token_counts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling


def brute_near(words):
    by, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[i, len(w), w[:i] + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute_variants(words, times=2):
    near, form = brute_near(words), {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= times * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return rows


@pytest.mark.parametrize(("letters", "lengths", "cells"), [("ab", range(9), 1 << 17), ("ab", range(9), 30), ("abcé\U0001f600", (5, 6, 7), 200), ("aaaaaab", (5, 6, 30, 31, 300), 1 << 17)])
def test_variants_against_brute_force(spark, letters, lengths, cells):
    """Blocks that fit and blocks that are parted to single places give the same."""
    r = random.Random(5)
    words = {"".join(r.choices(letters, k=r.choice(list(lengths)))): r.randint(1, 60) for _ in range(900)}
    got = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"), cells=cells).collect()
    assert {(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in got} == brute_variants(words) and len(got) == len(words)


def test_variants_of_one_hot_block(spark):
    """Thousands of words with one beginning and one end: the block is parted, and no link is lost."""
    words = {f"inter{a}{b}{c}national": 3 + ord(a) for a in "abcdefghij" for b in "abcdefghijk" for c in "abcdefgh"} | {"internationalx": 9, "intrnational": 4, "international": 1000}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.spelling_variants(rows, cells=500).collect()
    assert {(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in got} == brute_variants(words)
    sizes = spelling.blocks(rows, 500).groupBy("key", "a", "b").count().where("b - a > 1").agg(F.max(F.col("count") * (F.col("b") - F.col("a") + 1))).first()[0]
    assert sizes <= 500


def test_chain_of_forms(spark):
    words = {"a" * (5 + k): 3 << k for k in range(12)}
    got = {x["word"]: x for x in spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert {x["root"] for x in got.values()} == {"a" * 16} and got["a" * 16]["form"] is None


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def test_word_counts(spark, messy, nothing):
    r = random.Random(1)
    texts = [(k, " ".join(r.choice(["Häuser", "ÀPROPOS", "straße", "×÷words", "İstanbul", "Kelvin", "naïve1x", "ABCDEF", "x"]) + r.choice(["", "", "\n", "e"]) for _ in range(60))) for k in range(300)]
    df = spark.createDataFrame([*texts, (None, "häuser häuser Häuser"), (5, None)], "doc_id long, text string")
    want = brute_words([*texts, (None, "häuser häuser Häuser")])
    assert {x["word"]: x["n"] for x in spelling.word_counts(df).collect()} == want
    assert {x["word"]: x["n"] for x in spelling.word_counts(messy).collect()} == brute_words([(x["doc_id"], x["text"]) for x in messy.collect()])
    assert spelling.spelling_variants(spelling.word_counts(nothing)).collect() == []
    assert spelling.spelling_variants(spelling.word_counts(messy)).count() == spelling.word_counts(messy).count()


# --- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_vocabulary())
    return lambda texts: [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_against_library(spark, sf_dir, library):
    docs = [(x["doc_id"], x["text"] or "") for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (len(t.encode()), n, n > 2048) for (d, t), n in zip(docs, library([t for _, t in docs]), strict=True)}
    got = queries.op12_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs) and {x["doc_id"]: (x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in got} == want


LETTERS = [chr(c) for c in range(0x180)] + [*"''' \n\tsStTrRmMdDlLvVeE", "́", "̈", "İ", "K", "Σ", "ς", " ", "　", "​", "한", "ᄀ", "ᅡ", "ᆨ", "\U0001f600", "️", "漢字", "٣", "½", "<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>"]


@pytest.mark.parametrize("known", [0, 400])
def test_pre_tokens_add_up(library, known):
    """White space parts a text for the library as well, whatever stands beside it; pieces and the table change nothing."""
    r = random.Random(2)
    texts = ["".join(r.choices(LETTERS, k=r.randrange(40))) for _ in range(4000)] + ["", " ", "a" * 5000, " ".join(["word"] * 3000)]
    by = token_counts.lengths(token_counts.default_vocabulary())
    words = ["", *sorted({w for t in texts for w in t.split(" ") if w and not re.search("[\t-\r]", w)})[:known]]
    table = pa.table({"word": pa.array(words), "n": pa.array([0, *by.encoded(words[1:])], pa.int64())})
    assert token_counts.counted(pa.array(texts), table, by, size=200).tolist() == library(texts)


def test_worker_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 50)
    by = token_counts.Lengths(token_counts.default_vocabulary())
    words = [f"word{k}x" for k in range(400)]
    for at in range(0, 400, 40):
        assert by.of(words[at : at + 40]).tolist() == library(words[at : at + 40]) and len(by.known) + len(by.older) <= 150
    assert by.of(words).tolist() == library(words) and len(by.known) + len(by.older) <= 150


def test_token_counts_edges(messy, nothing, library):
    got = token_counts.token_counts(messy).collect()
    rows = messy.select("doc_id", "text").collect()
    want = Counter((x["doc_id"], n, len((x["text"] or "").encode())) for x, n in zip(rows, library([x["text"] or "" for x in rows]), strict=True))
    assert Counter((x["doc_id"], x["n_tokens"], x["n_bytes"]) for x in got) == want
    assert token_counts.token_counts(nothing).collect() == []
    assert sum(map(token_counts.takes_part, range(100_000))) < token_counts.SAMPLED * 12 and all(map(token_counts.takes_part, range(token_counts.SAMPLED)))


def test_vocabularies_in_which_white_space_counts(library):
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        token_counts.check_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


# --- filter audit


def brute_audit(docs, labels):
    """docs: (doc_id, text, lang); every order is run as a cascade."""
    ids = defaultdict(list)
    for d, t, _ in docs:
        if d is not None:
            ids[t or ""].append(d)
    flags = defaultdict(lambda: [False, False])
    for d, q, x in labels:
        flags[d] = [flags[d][0] or q == 1, flags[d][1] or x == 1]
    rows = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = re.findall("[^\\x20\\x09-\\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > min(ids[t])}
        rows[lang or ""].append((fails, *(flags[d] if d is not None else (False, False))))
    out = {}
    for part, all_rows in rows.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            live, gone = all_rows, []
            for step, f in enumerate(order, 1):
                here = [r for r in live if r[0][f]]
                out[part, order, step] = [len(live) - len(here), len(here), sum(r[0][f] for r in gone), sum(r[0][f] and sum(r[0].values()) == 1 for r in all_rows), sum(r[1] for r in here), sum(r[2] for r in here)]
                total[f] += len(here)
                live, gone = [r for r in live if not r[0][f]], gone + here
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    got = df.collect()
    out = {(x["part"], x["filter_order"], x["step"]): (x["kept"], x["removed"], x["redundant"], x["unique_fails"], x["good_lost"], x["toxic_lost"], x["shapley"]) for x in got}
    assert len(out) == len(got)
    return out


def test_audit_against_cascades(spark, messy, nothing):
    r = random.Random(4)
    words = ["word", "Upper", "CAPS", "x#", "y", *[f"w{k}" for k in range(300)]]
    texts = [None, "", "same text", *[" ".join(r.choices(words, k=r.choice([3, 150, 260]))) for _ in range(12)], "é" * 50 + "ABC"]
    docs = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["en", "", None])) for _ in range(150)]
    labels = [(r.choice([None, *range(60)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(50)]
    known = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    assert audited(filter_audit.filter_audit(df, known)) == brute_audit(docs, labels)
    assert audited(filter_audit.filter_audit(messy, known)) == brute_audit([(x["doc_id"], x["text"], x["lang"]) for x in messy.collect()], labels)
    assert audited(filter_audit.filter_audit(df, known.limit(0))) == brute_audit(docs, [])
    assert filter_audit.filter_audit(nothing, known).collect() == []


def test_parity_sums_are_their_own_inverse(spark):
    rows = [(m, (m * 7919) % 101) for m in range(32)]
    df = spark.createDataFrame(rows, "mask int, n long").select("mask", "n", F.lit("p").alias("part"), (F.col("mask") % 3 == 0).alias("good"), F.lit(False).alias("toxic"))
    got = filter_audit.mask_counts(filter_audit.parity_sums(df)).first()
    assert got["n"] == [n for _, n in rows] and got["good"] == [n if m % 3 == 0 else 0 for m, n in rows] and not np.any(got["toxic"])
