"""Queries against brute force on the smallest tables."""

import hashlib
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from massloom.llm import chat_format, embedding_dedup, licenses, line_dedup, mixing, packing, quality, queries, sharding, simhash, simhash_jaccard

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, coalesce(text, ''), source FROM '{sf_dir}/documents.parquet'").fetchall()}


def components(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_embedding_dedup", "op9_chat_format", "op10_exact_dedup", "op11_spelling", "op13_filter_audit"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert Counter(want.fetchall()) == Counter(tuple(r[c] for c in cols) for r in queries.queries()[name](spark, sf_dir).collect())


def brute_deleted(texts, size):
    """Lines covered by a window of ``size`` lines that starts earlier elsewhere."""
    seen, gone = set(), defaultdict(set)
    for doc, lines in texts:
        for i in range(len(lines) - size + 1):
            w = tuple(lines[i : i + size])
            if w in seen:
                gone[doc] |= set(range(i, i + size))
            seen.add(w)
    return gone


@pytest.mark.parametrize("size", [1, 2, 4, 5])
def test_line_runs(spark, size):
    rng = np.random.default_rng(size)
    texts = [(i, ["l%d" % k for k in rng.integers(0, 4, rng.integers(1, 30))]) for i in range(40)]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts], "doc_id long, text string")
    gone = brute_deleted(texts, size)
    for r in line_dedup.line_dedup(df, size).collect():
        lines = dict(texts)[r["doc_id"]]
        assert {k for a, b in r["removed_runs"] for k in range(a, b + 1)} == gone[r["doc_id"]]
        assert r["clean_text"] == "\n".join(x for k, x in enumerate(lines) if k not in gone[r["doc_id"]])


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_suffix_array_and_common_prefixes(spark, depth):
    """Neighbours in the array have the common prefix that it says, and every repeat is an interval of it."""
    rng = np.random.default_rng(depth)
    texts = {i: ["l%d" % k for k in rng.integers(0, 5, rng.integers(1, 25))] for i in range(30)} | {30: ["a", "b", "c", "d", "e", "x"], 31: ["q", "a", "b", "c", "d", "e", "y"]}
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string")
    got = sorted(line_dedup.lcp_array(line_dedup.ranks_by_depth(df, depth)).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(got)))
    suffix = [texts[r["doc_id"]][r["line"] :] for r in got]

    def common(x, y):
        n = 0
        while n < min(len(x), len(y), depth) and x[n] == y[n]:
            n += 1
        return n

    assert [r["lcp"] for r in got[1:]] == [common(x, y) for x, y in zip(suffix, suffix[1:], strict=False)] and got[0]["lcp"] == 0
    # the longest prefix that any two places share is the least along the array between them: intervals hold every repeat
    every = [texts[d][k:] for d in texts for k in range(len(texts[d]))]
    for k in range(1, depth + 1):
        want = Counter(tuple(s[:k]) for s in every if len(s) >= k)
        runs, last = Counter(), None
        for r, s in zip(got, suffix, strict=True):
            last = last if last is not None and r["lcp"] >= k else (tuple(s[:k]) if len(s) >= k else None)
            runs[last] += 1
        assert all(runs[w] == n for w, n in want.items() if n > 1)


def test_licenses(spark, sf_dir, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in queries.queries()["op2_licenses"](spark, sf_dir).collect():
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]][0]))
        hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert r["base_labels"] == ",".join(sorted({h[1] for h in hits})) and 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


def test_matching_statistics():
    """Maximal matches equal those of a search at every place."""
    a = licenses.Scanner({"t": "a b c d e f a b c g", "u": "x a b c d y"}, {"c d": "p"}, 3)
    rng = np.random.default_rng(5)
    for _ in range(300):
        words = [str(w) for w in rng.choice(list("abcdefgxyz"), 25)]
        for label, spans in ((s[0], s) for s in a.scan(" ".join(words))[7]):
            _, f, t, n = spans
            assert words[f : f + n] == a.templates[label][t : t + n]
    n, base, first, last, labels, _, score, _ = a.scan("z a b c d e f a b c g z")
    assert (n, base, first, last, labels, score) == (12, 1, 3, 3, "p", 1.0)


def test_long_matches_are_all_and_chains_are_best():
    """Matching statistics by a search at every place, and the chain by trying every predecessor."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        templates = {n: " ".join(rng.choice(list("abcde"), 30)) for n in "tuv"}
        a = licenses.Scanner(templates, {"a b": "p"}, 3)
        words = [str(w) for w in rng.choice(list("abcdex"), 40)]
        strings = [a.templates[n] for n in "tuv"] + [["a", "b"]]

        def longest(end, words=words, strings=strings):
            n = 0
            while n < end and any(words[end - n - 1 : end] == x[i : i + n + 1] for x in strings for i in range(len(x) - n)):
                n += 1
            return n

        size = [longest(e) for e in range(len(words) + 1)]
        want = [(e, size[e]) for e in range(1, len(words) + 1) if size[e] >= 3 and (e == len(words) or size[e + 1] <= size[e])]
        assert [(e, n) for e, n, _ in a.matches(words)[1]] == want
        places = []
        for e, n in want:
            places += [(e - n, i, n) for i in range(31 - n) if a.templates["t"][i : i + n] == words[e - n : e]]
        places = sorted(set(places))
        best = [0] * len(places)
        for k, (f, t, n) in enumerate(places):
            best[k] = n + max([best[j] for j, (g, u, m) in enumerate(places) if g + m <= f and u + m <= t], default=0)
        got = licenses.chain(places)
        assert sum(n for _, _, n in got) == max(best, default=0)
        assert all(f + n <= g and t + n <= u for (f, t, n), (g, u, _) in zip(got, got[1:], strict=False))


def test_catalogue_tells_licences_apart():
    texts = licenses.whole_texts()
    s = licenses.Scanner(licenses.NOTICES | texts, licenses.PHRASES, 5)
    assert len(texts) >= 16
    for name, text in texts.items():
        out = s.scan(f"Header words. {text.upper()} trailing words")
        assert name in out[5].split(",") and out[6] == 1.0 and len(text.split()) == sum(n for label, _, _, n in out[7] if label == name)
    assert s.scan("no licence here at all, only the words of any other text")[5:7] == ("", 0.0)


def test_template_spans_survive_edits():
    words = licenses.whole_texts()["mit"].split()
    s = licenses.Scanner(licenses.whole_texts(), licenses.PHRASES, 5)
    words[30:31] = ["changed", "here"]
    out = s.scan("Intro. " + " ".join(words))
    assert "mit" in out[5] and 0.9 < out[6] < 1.0 and len(out[7]) >= 2


def test_packing(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: t.encode(x[0], add_special_tokens=False).ids + [0] for d, x in docs.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in queries.queries()["op3_packing"](spark, sf_dir).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == ids.keys()
    padding = 0
    for parts, want in [(v, len(ids[k])) for k, v in by_doc.items()] + [(v, None) for v in by_seq.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == want if want is not None else at <= 1024
        padding += 1024 - at if want is None and at & (at - 1) else 0
    assert padding < 1024 * 8


def test_step_groups_are_even(spark):
    """Over all partitions, and window ids are dense."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    got = packing.packed(df, group_tokens=20_000).groupBy("sequence_id", "tier", "step_group").agg(F.sum("length").alias("n")).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    tokens, by_tier = Counter(), defaultdict(Counter)
    for r in got:
        tokens[r["step_group"]] += r["n"]
        by_tier[r["tier"]][r["step_group"]] += 1
    groups = round(sum(tokens.values()) / 20_000)
    assert len(tokens) == groups > 10 and all(max(c[g] for g in range(groups)) - min(c[g] for g in range(groups)) <= 1 for c in by_tier.values())
    assert max(tokens.values()) - min(tokens.values()) <= sum(packing.TIERS)


def test_sharding(spark, sf_dir, docs):
    got = queries.queries()["op4_sharding"](spark, sf_dir).collect()
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in queries.queries()["op4_sharding"](spark, sf_dir).collect()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == again
    by = defaultdict(list)
    for r in got:
        raw = docs[r["doc_id"]][0].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw)) and r["grown_shard"] in (r["shard"], 8)
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(r["grown_shard"] == 8 for r in got) > 5
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["slot"]) if r["shard"] == 0]
    assert order != sorted(order)


def brute_fingerprint(text, width=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, sf_dir, docs):
    order = sorted(docs)
    fp = [brute_fingerprint(docs[d][0]) for d in order]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    label = components(len(fp), links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.queries()["op7_simhash"](spark, sf_dir).collect()}
    assert got == {d: (f"{fp[i]:016x}", order[label[i]]) for i, d in enumerate(order)}


@pytest.mark.parametrize("limit", [4, 50, 2000])
def test_near_links_lose_none(spark, limit):
    """Also where keys are hot at every level."""
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(12)]
    dense = [np.uint64(int(base[0]) ^ (1 << i) ^ (1 << j)) for i in range(20) for j in range(i)]
    fp = np.unique(np.array([*base, *near, *dense], np.uint64))
    links = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3]
    want = components(len(fp), links)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    at = {int(v): k for k, v in enumerate(fp.view(np.int64))}
    found = [(at[r["a"]], at[r["b"]]) for r in simhash.near_links(df, 3, limit=limit).collect()]
    assert components(len(fp), found) == want


def test_thresholds_follow_the_data():
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    skewed = flat & ~np.uint64((1 << 12) - 1)  # the last 12 bits are all alike
    parts = simhash.correlated_partitions(skewed, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    chosen = simhash.allocate(skewed, [list(range(k, k + 16)) for k in range(0, 64, 16)], 3)
    assert sum(chosen) == 0 and chosen[0] == -1 and 1 in chosen  # the dull partition is not probed


def test_mixing(spark, sf_dir, docs):
    got = queries.queries()["op8_mixing"](spark, sf_dir).collect()
    size = {d: len(WORD.findall(x[0])) for d, x in docs.items()}
    by = Counter()
    for d, x in docs.items():
        by[x[1]] += size[d]
    names = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(by.values())
    while True:
        over = [s for s in open_ if rest * weight[s] / sum(weight[o] for o in open_) > 2 * by[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * by[s]
        rest -= sum(target[s] for s in over)
        open_ -= set(over)
    target |= {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
    taken = Counter()
    for r in got:
        s = docs[r["doc_id"]][1]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[s] and abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    largest = {s: max(size[d] for d, x in docs.items() if x[1] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in queries.queries()["op8_mixing"](spark, sf_dir).collect()}


def test_min_cost_flow_prefers_first_passes():
    # "both" can serve either source: it must leave a's only supply to a and serve b, so that nothing repeats
    flow = mixing.min_cost_flow({("a",): 10.0, ("a", "b"): 10.0}, {"a": 10.0, "b": 10.0}, {("a",): ["a"], ("a", "b"): ["a", "b"]})
    assert flow == {(("a",), "a"): 10.0, (("a", "b"), "b"): 10.0}
    flow = mixing.min_cost_flow({("a", "b"): 10.0, ("a",): 4.0}, {"a": 12.0, "b": 9.0}, {("a", "b"): ["a", "b"], ("a",): ["a"]})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 12.0 and sum(v for (_, s), v in flow.items() if s == "b") == 9.0


def test_min_cost_flow_is_best():
    """The most words that can be routed, at the least cost of repetition, by trying every flow."""
    import itertools

    rng = np.random.default_rng(11)
    member = {("a",): ["a"], ("b",): ["b"], ("a", "b"): ["a", "b"], ("b", "c"): ["b", "c"]}
    arcs = [(p, s) for p, sources in member.items() for s in sources]
    for _ in range(25):
        supply = {p: float(rng.integers(0, 3)) for p in member}
        quota = {s: float(rng.integers(0, 6)) for s in "abc"}
        best = (0.0, 0.0)
        for x in itertools.product(*[range(int(min(2 * supply[p], quota[s])) + 1) for p, s in arcs]):
            given, taken = Counter(), Counter()
            for (p, s), n in zip(arcs, x, strict=True):
                given[p] += n
                taken[s] += n
            if all(given[p] <= 2 * supply[p] for p in member) and all(taken[s] <= quota[s] for s in quota):
                best = max(best, (sum(x), -sum(max(0.0, given[p] - supply[p]) for p in member)))
        flow = mixing.min_cost_flow(supply, quota, member)
        given = Counter()
        for (p, _), n in flow.items():
            given[p] += n
        assert (sum(flow.values()), -sum(max(0.0, given[p] - supply[p]) for p in member)) == best


def test_more_sources_than_the_driver_plans(spark, sf_dir):
    """The plan that executors make is the driver's."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 11 > 0, F.concat("source", F.lit("/"), F.col("doc_id") % 3)))
    for share in (1.5, 0.3, 5.0):
        one, two = ({r["doc_id"]: r for r in mixing.mix(df, total_share=share, max_patterns=n).collect()} for n in (10**6, 3))
        none = [r for r in one.values() if r["pattern"] == [None]]  # the null source has its share like others
        assert none and abs(sum(r["taken"] for r in none) - none[0]["target"]) <= max(r["size"] for r in none)
        assert one.keys() == two.keys() and all(one[d]["taken"] == two[d]["taken"] and one[d]["source_size"] == two[d]["source_size"] and abs(one[d]["target"] - two[d]["target"]) < 1e-6 for d in one)


def overlapping(rng, n_patterns, n_sources):
    member = {}
    while len(member) < n_patterns:
        p = tuple(sorted({f"s{int(n_sources * rng.random() ** 2):03}" for _ in range(rng.integers(1, 7))}))
        member[p] = list(p)
    supply = {p: float(rng.integers(0, 50)) for p in member}
    names = sorted({s for p in member for s in p})
    total = sum(supply.values())
    share = rng.dirichlet(np.full(len(names), 0.4)) * total * rng.choice([0.7, 1.5, 2.5])
    return supply, {s: float(round(q)) for s, q in zip(names, share, strict=True)}, member


def words_and_repeats(supply, quota, member, flow):
    """(words, words given again) of a flow, after its bounds are checked."""
    given, into = Counter(), Counter()
    for (p, s), x in flow.items():
        assert s in member[p] and x > 0
        given[p] += x
        into[s] += x
    assert all(given[p] <= 2 * supply[p] + 1e-4 for p in member) and all(into[s] <= quota[s] + 1e-4 for s in quota)
    return sum(given.values()), sum(max(0.0, given[p] - supply[p]) for p in member)


def most_words(supply, quota, member, times):
    """The maximum flow by its least cut: over all sets of sources."""
    names = list(quota)
    return min(sum(quota[s] for i, s in enumerate(names) if cut >> i & 1) + sum(times * x for p, x in supply.items() if any(not cut >> names.index(s) & 1 for s in member[p])) for cut in range(1 << len(names)))


def test_flows_meet_their_least_cuts(spark):
    """Driver's and executors' flow: the most words, and as few of them again as the cut of the first pass lets be."""
    for seed in range(12):
        supply, quota, member = overlapping(np.random.default_rng(seed), 14, 7)
        once, twice = most_words(supply, quota, member, 1), most_words(supply, quota, member, 2)
        flows = [mixing.min_cost_flow(supply, quota, member)]
        if seed < 4:
            names = list(quota)
            df = spark.createDataFrame([(list(p), [names.index(s) for s in p], x) for p, x in supply.items()], "pattern array<string>, members array<long>, words double")
            rows = mixing.flow_on_executors(df, [quota[s] for s in names]).collect()
            flows.append({(tuple(r["pattern"]), names[s]): x for r in rows for s, x in zip(r["members"], r["flow"], strict=True) if x > 1e-6})
        for flow in flows:
            words, again = words_and_repeats(supply, quota, member, flow)
            assert abs(words - twice) < 1e-3 and abs(words - again - once) < 1e-3


def test_flow_of_many_patterns_is_quick():
    supply, quota, member = overlapping(np.random.default_rng(1), 8000, 60)
    start = time.perf_counter()
    flow = mixing.min_cost_flow(supply, quota, member)
    assert time.perf_counter() - start < 5
    words_and_repeats(supply, quota, member, flow)


def test_more_patterns_than_the_driver_plans(spark):
    names = [["a"], ["b"], ["a", "b"], [], ["b", "c"], ["c", "d", None], ["a", "d"]]
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), names[i * i % 7]) for i in range(700)], "doc_id long, text string, source array<string>")
    for share in (1.5, 0.3):
        one, two = (mixing.mix(df, total_share=share, max_patterns=n).collect() for n in (100, 3))
        assert {(r["doc_id"], r["source_size"], round(r["target"], 6)) for r in one} == {(r["doc_id"], r["source_size"], round(r["target"], 6)) for r in two}
        for f in (lambda r: r["taken"], lambda r: max(0, r["taken"] - r["size"])):
            assert abs(sum(map(f, one)) - sum(map(f, two))) <= 7 * 7  # the last document of a pattern may be taken or left


def test_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 7), [["a"], ["b"], ["a", "b"], []][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(df).collect()
    assert len(got) == 400 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where(F.pmod(F.hash("doc_id"), F.lit(4)) == 0)
    scorer = quality.train(docs, labels.join(held, "doc_id", "left_anti"))
    got = quality.score(docs, scorer).join(held.select("doc_id", F.col("quality")), "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [not r["kept"] for r in got if r["quality"] == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) >= 0.8


def two_views(seed, n=3000, known=24):
    """Views that are independent given the class; the content view has many columns for its few labelled rows."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    text = np.hstack([y[:, None] * 1.2 + rng.normal(0, 1, (n, 8)), rng.normal(0, 1, (n, 40))])
    meta = y[:, None] * 3.0 + rng.normal(0, 1, (n, 2))
    return text, meta, y, np.arange(n) < known


def test_views_teach_each_other():
    """Fails when the exchange is off: the content view learns from the other's pseudo-labels."""
    gains = []
    for seed in range(5):
        text, meta, y, known = two_views(seed)
        right = {}
        for rounds in (0, 6):
            pool = quality.ArrayPool(text[~known], meta[~known])
            scorer = quality.co_train(text[known], meta[known], y[known], pool, rounds=rounds, stats=(0, 0))
            _, t, m = scorer.score(text[~known], meta[~known])
            right[rounds] = np.mean((scorer.text.odds(text[~known]) >= 0) == (y[~known] == 1))
        gains.append(right[6] - right[0])
    assert np.mean(gains) > 0.08 and min(gains) > 0.02


def test_training_on_a_table_is_training_on_arrays(spark, sf_dir):
    """Rounds that executors run over the whole pool pick what a sort of all rows in memory picks, and give the same model."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    table = quality.features(docs).toPandas()
    t, m = (np.stack([np.frombuffer(x, np.float32) for x in table[c]]).astype(float) for c in ("t", "m"))
    label = labels.groupBy("doc_id").agg(F.avg("quality").alias("y")).toPandas().set_index("doc_id")["y"]
    own = table["doc_id"].isin(label.index).to_numpy()
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h")).collect()}
    at = np.array(sorted(np.flatnonzero(own), key=lambda i: order[table["doc_id"][i]]))
    pool = quality.ArrayPool(t[~own], m[~own], table["key"].to_numpy()[~own])
    want = quality.co_train(t[at], m[at], (label[table["doc_id"][at]].to_numpy() >= 0.5).astype(float), pool, sure=0.8)
    got = quality.train(docs.repartition(5), labels, sure=0.8)
    assert np.allclose(got.text.weight, want.text.weight, atol=1e-6) and np.allclose(got.meta.weight, want.meta.weight, atol=1e-6) and np.allclose(got.mix, want.mix, atol=1e-6)


def test_both_views_beat_each_alone(spark):
    """On held-out labels the mix is at least as good as either view, and the metadata view, which sees nothing of the text, is better than chance.
    With few labels an exchange between a strong view and one that knows next to nothing does no harm."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where(F.pmod(F.hash("doc_id"), F.lit(3)) == 0)
    table = quality.materialize(quality.features(docs), "features")
    scorer = quality.train_on(table, labels.join(held, "doc_id", "left_anti"))
    got = quality.score_features(table, scorer).join(held.select("doc_id", "quality"), "doc_id").toPandas()

    def auc(s):
        rank = s.rank()
        good = got["quality"] == 1
        return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())

    text, meta, both = auc(got["text_score"]), auc(got["meta_score"]), auc(got["quality_score"])
    print("auc", text, meta, both, scorer.mix)
    assert meta > 0.52 and both >= max(text, meta) - 0.002 and scorer.mix[1] >= 0
    rows = table.toPandas()
    t, m = (np.stack([np.frombuffer(x, np.float32) for x in rows[c]]).astype(float) for c in ("t", "m"))
    label = rows["doc_id"].map(labels.groupBy("doc_id").agg(F.avg("quality").alias("y")).toPandas().set_index("doc_id")["y"])
    labelled = np.flatnonzero(label.notna())
    for n in (40, 100):
        found = {0: [], 4: []}
        for seed in range(4):
            mixed = np.random.default_rng(seed).permutation(labelled)
            known, rest = mixed[:n], np.setdiff1d(np.arange(len(rows)), mixed[:n])
            got = rows.iloc[mixed[n:]].assign(quality=(label.iloc[mixed[n:]] >= 0.5).astype(int))
            for rounds, aucs in found.items():
                s = quality.co_train(t[known], m[known], (label.iloc[known] >= 0.5).to_numpy().astype(float), quality.ArrayPool(t[rest], m[rest]), rounds=rounds)
                aucs.append(auc(pd.Series(s.score(t[mixed[n:]], m[mixed[n:]])[0], index=got.index)))
        print("few labels", n, found)
        assert np.mean(found[4]) >= np.mean(found[0]) - 0.003


def test_quality_fit_widens_a_slice_at_a_time(monkeypatch):
    """The driver never holds all widened rows, and slices fit the same model."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1700, 6))
    y = (x[:, 0] + rng.normal(size=1700) > 0).astype(float)
    expand, seen = quality.Logistic._expand, []
    monkeypatch.setattr(quality.Logistic, "_expand", lambda self, rows: seen.append(len(rows)) or expand(self, rows))
    parts = quality.Logistic.fit(x, y, 2)
    odds = parts.odds(x)
    assert max(seen) <= quality.SLICE and len(parts.odds(x[:0])) == 0
    monkeypatch.setattr(quality, "SLICE", 5000)
    assert np.allclose(odds, quality.Logistic.fit(x, y, 2).odds(x), atol=1e-9)


def test_views_are_parted(spark):
    """Metadata features do not move with the text, nor content features with metadata."""
    rows = [(1, "Alpha beta | gamma\n" * 9, "en", "web", 120), (2, "x", "en", "web", 120), (3, "x", "de", None, 7)]
    got = {r["doc_id"]: r for r in quality.features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[1]["m"] == got[2]["m"] != got[3]["m"] and got[1]["t"] != got[2]["t"] == got[3]["t"]


def test_proof_of_teaching():
    ones = lambda n: np.ones(n)
    assert not quality.proven(ones(0), 0.0) and not quality.proven(ones(2), 0.5) and quality.proven(ones(3), 0.5)
    assert not quality.proven(ones(15), 0.857) and quality.proven(ones(17), 0.857) and not quality.proven(np.repeat([1.0, 0.0], [86, 14]), 0.857)


def test_embedding_blocks_and_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, np.repeat(base[:20], 6, axis=0) + rng.normal(0, 0.04, (120, 16)), np.repeat(base[:1], 30, axis=0)]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    label[-30:] = label[0]
    df = spark.createDataFrame([(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    sim = np.einsum("ik,jk->ij", u, u)
    links = [(i, j) for i in range(len(u)) for j in range(len(u)) if i != j and label[i] == label[j] and sim[i, j] >= 0.98]
    n = Counter(i for i, _ in links)
    comp = components(len(u), links)
    for options in ({"block": 8, "query_block": 16}, {}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df, **options).collect()}
        assert got == {i: (n[i], comp[i]) for i in range(len(u))}


@pytest.mark.parametrize(("dim", "rank"), [(64, 3), (64, 64), (256, 5), (768, 3), (768, 8)])
def test_embedding_links_in_few_directions(spark, dim, rank):
    """All links, where vectors differ in few directions and lists have boundaries everywhere; counted alike from both ends."""
    rng = np.random.default_rng(dim + rank)
    basis = np.linalg.qr(rng.normal(size=(dim, rank)))[0]
    x = (rng.normal(size=(1500, rank)) @ basis.T).astype(np.float32)
    x[1000:] = x[:500] * rng.uniform(0.5, 2, (500, 1)).astype(np.float32) + (rng.normal(0, 0.12 / np.sqrt(rank), (500, rank)) @ basis.T).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    sim = u @ u.T
    same = (np.arange(1500)[:, None] - np.arange(1500)) % 2 == 0
    links = [(i, j) for i, j in np.argwhere((sim >= 0.98) & same).tolist() if i != j]
    clear = {i for i, j in np.argwhere((abs(sim - 0.98) < 1e-12) & same).tolist()}
    n, comp = Counter(i for i, _ in links), components(1500, links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df, block=200).collect()}
    assert len(links) > 200 and not clear and got == {i: (n[i], comp[i]) for i in range(1500)}


def test_chat_round_trip(spark, sf_dir):
    hostile = queries.HOSTILE
    assert chat_format.unescape(chat_format.escape(hostile)) == hostile == "\\### Assistant: </turn> ok"
    for text in ("", "\\", "###", "\\\\###", "</turn></turn>", "a \\\\\\</turn> ####", "######"):
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not re.search(r"(?<!\\)(?:\\\\)*(?:###|</turn>)", chat_format.escape(text).replace("####", "###")) or text == "a"
    got = {r["conv_id"]: r for r in queries.queries()["op9_chat_format"](spark, sf_dir).collect()}
    assert got[-7]["loss_sha256"] == hashlib.sha256(hostile.encode()).hexdigest() and got[-7]["loss_chars"] == len(hostile)


def test_pipeline(spark, sf_dir, docs):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r["doc_id"] for r in out}
    assert kept and kept <= set(docs)
    norm = [re.sub("[\\x20\\x09-\\x0D]", "", docs[d][0]) for d in kept]
    assert len(norm) == len(set(norm))
    fp = [brute_fingerprint(docs[d][0]) for d in kept]
    assert not [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]


def brute_jaccard_components(texts, least=0.8):
    sets = []
    for t in texts:
        w = [x.lower() for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    return components(len(sets), links)


def edited_texts():
    """Copies with more and more words changed, about both sides of similarity 0.8, a shared passage, short and empty texts."""
    rng = np.random.default_rng(8)
    texts = [None, "", "one two", "One  two", "one two three four five"]
    passage = " ".join(f"p{k}" for k in range(40))
    for c in range(12):
        base = [f"c{c}w{k}" for k in rng.integers(0, 400, 150)]
        for edits in range(10):
            words = list(base)
            for at in rng.choice(150, edits, replace=False):
                words[at] = f"e{rng.integers(1e9)}"
            texts.append(" ".join(words) + (f" {passage}" if c % 3 == 0 else ""))
    return texts


@pytest.mark.parametrize(("limit", "block"), [(4, 3), (4, 256), (64, 5), (4096, 256)])
def test_near_components_are_exact(spark, limit, block):
    """Also where groups are over the limit, or of several blocks."""
    texts = edited_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash_jaccard.near_components(df, limit=limit, block=block).collect()}
    want = brute_jaccard_components(texts)
    assert len(set(want)) < len(texts) - 40 and len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values()))


def test_near_stage_by_jaccard(spark):
    texts = edited_texts()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_jaccard_components(texts)
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, "").collect()} == {i for i, c in enumerate(want) if i == c}


def test_packing_of_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext", "  <|endoftext|>\n\n z", "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in packing.packed(df).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        own = ids[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))


def test_long_passages_of_few_lines(spark):
    """Runs of one and two lines go where they hold over 50 words; short ones stay."""
    rng = np.random.default_rng(6)
    pool = [" ".join(f"v{k}w{i}" for i in range(n)) for k, n in enumerate((2, 3, 30, 30, 49, 50, 51, 60))]
    texts = [(None, [pool[7]])] + [(i, [pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 6))]) for i in range(25)]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts], "doc_id long, text string")
    want = brute_deleted(texts, 3)
    for size in (1, 2):
        seen = set()
        for doc, lines in texts:
            for i in range(len(lines) - size + 1):
                w = tuple(lines[i : i + size])
                if w in seen and sum(len(x.split()) for x in w) > 50:
                    want[doc] |= set(range(i, i + size))
                seen.add(w)
    got = {r["doc_id"]: {k for a, b in r["removed_runs"] for k in range(a, b + 1)} for r in line_dedup.line_dedup(df, long_words=50).collect()}
    assert got == {doc: want[doc] for doc, _ in texts} and want[1]


def test_shards_hold_whole_rows(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.sharding(df, path=f"file://{tmp_path}/shards").count()
    back = spark.read.parquet(f"file://{tmp_path}/shards").select(*[F.col(f"doc_{c}").alias(c) for c in df.columns])
    assert Counter(back.collect()) == Counter(df.collect())
