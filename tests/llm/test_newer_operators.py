"""Byte-pair encoding, lexical search and the Merkle manifest against brute force, on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from agromix.llm import lexical, merkle
from agromix.llm.bpe import LONG, PrefixBPE, decode_ids, encode_ids, model_file
from agromix.llm.lexical import Best, Treaps, best_of_shard, build_index, rank, statistics, terms_of
from agromix.llm.merkle import block_root, manifest, traverse
from agromix.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, source string, lang string, n_chars int, ids string, DECODED string, tree string, pos string, score string, item string"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{int(rng.random() ** 3 * vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    long = words(rng, 20_000, 4000)
    texts = [None, "", " \n\t ", "--", "One w1 W2", "Straße ÉTÉ w3", long, long + " w1", "a" * 5000, "x<|endoftext|>y", "  two  blanks \n\n end "] + [words(rng, rng.randrange(1, 80)) for _ in range(300)] + ["w1 w2 w3 Copied text"] * 120
    out = [(i, t, None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}", None if i % 7 else "en", None if t is None else len(t), "i", "d", "t", "p", "s", "x") for i, t in enumerate(texts)]
    return [*out, out[20], out[20], (None, "no identifier w1", "hot", None, 3, *["z"] * 6), (10_000, "lone", "lone", "de", 4, *["z"] * 6)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def model():
    return PrefixBPE(model_file())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model_file())


def odd_texts():
    rng = random.Random(7)
    alphabet = ["a", "b", "e", "t", "h", " ", " ", "\n", "é", "\U0001f600", "1", "2", "'", "s", "-", "<", "in", "the", "\t", "　", "\x85", "\x1c", "er", "<|endoftext|>"]
    out = ["", "a" * 3000, " " * 700, "it's  we'll\n\n", "\n", "  lead", "trail  ", "ab" * LONG + "x", "<|endoftext|><|endoftext|>"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    out += ["".join(rng.choice("abe") for _ in range(rng.randrange(1, 3 * LONG))) for _ in range(200)]
    return out + ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(30)) for _ in range(500)]


def test_prefixes_encode_as_the_library(model, library):
    texts = odd_texts()
    got = model.encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert model.decode(np.concatenate(got), np.array([len(x) for x in got])) == texts
    rng = random.Random(1)
    ids = [rng.choices(range(model.size), k=rng.randrange(30)) for _ in range(500)]  # mostly no UTF-8
    assert model.decode(np.array(sum(ids, [])), np.array([len(x) for x in ids])) == library.decode_batch(ids, skip_special_tokens=False)
    with pytest.raises(ValueError, match="identifiers"):
        model.decode(np.array([model.size]), np.array([1]))


def test_pair_verdicts_equal_merging(model):
    """A pair stays apart just when merging its bytes from scratch, lowest rank first, gives the two tokens."""
    rng = random.Random(2)
    usable = np.flatnonzero(model.usable).tolist()
    ranks = {(int(a), int(b)): (int(model.rank[c]), c) for c, (a, b) in enumerate(zip(model.left, model.right, strict=True)) if a >= 0}
    byte = {model.bytes[i]: i for i in usable if len(model.bytes[i]) == 1}

    def merged(text):
        ids = [byte[text[i : i + 1]] for i in range(len(text))]
        while pairs := [(*ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]:
            _, whole, i = min(pairs, key=lambda x: (x[0], x[2]))
            ids[i : i + 2] = [whole]
        return ids

    a = [rng.choice(usable) for _ in range(1500)] + [usable[i] for i in range(300)]
    b = [rng.choice(usable) for _ in range(1500)] + [usable[i] for i in range(300)]
    halves = [int(x) for x in rng.sample(np.flatnonzero(model.left >= 0).tolist(), 300)]
    a, b = a + [int(model.left[x]) for x in halves], b + [int(model.right[x]) for x in halves]
    assert model._unmerged(np.array(a), np.array(b)).tolist() == [merged(model.bytes[x] + model.bytes[y]) == [x, y] for x, y in zip(a, b, strict=True)]
    assert merged(model.bytes[halves[0]]) == [halves[0]]


def test_words_together_equal_words_alone(model):
    rng = random.Random(4)
    some = [bytes(rng.choice(b"abet h") for _ in range(rng.randrange(1, 40))) for _ in range(500)] + [b""]
    assert model.words(some) == [model._alone(w) for w in some]
    model.memo.clear()
    assert [x.tolist() for x in model.encode(["the the thing"])] == [x.tolist() for x in model.encode(["the the thing"])]


def test_words_beyond_the_memo(library, monkeypatch):
    from agromix.llm import bpe

    monkeypatch.setattr(bpe, "MEMO", 40)
    small, rng = PrefixBPE(model_file()), random.Random(9)
    for _ in range(4):
        texts = [words(rng, 50, 500) for _ in range(20)]
        assert [x.tolist() for x in small.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(small.memo) <= 40


def test_encode_and_decode(docs, rows, library):
    got = decode_ids(encode_ids(docs)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in rows)
    assert {r["tree"] for r in got} == {"t", "z"} and [c.lower() for c in got[0].__fields__].count("decoded") == 1
    assert decode_ids(docs.select(F.lit(None).cast("array<int>").alias("ids"))).filter("decoded = ''").count() == len(rows)


def test_op11_counts(spark, folder, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op11_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))


def scores_by_hand(rows, query):
    """(doc_id, score) of all rows with a score, best first."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in pattern.findall(t or "")]
    docs = [(i, Counter(split(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, length = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for i, c, size in docs:
        m = 100 - 50 + (50 * size * n) // length
        score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(query)) if t in c)
        if score > 0:
            out.append((i, score))
    return sorted(out, key=lambda x: (-x[1], x[0] is None, x[0] or 0))


@pytest.mark.parametrize(("shard", "postings", "block"), [(1 << 14, 1 << 20, 1024), (16, 200, 2)])
def test_rank_against_all_scores(spark, docs, rows, monkeypatch, shard, postings, block):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "QUERIES", block)
    asked = [(1, "w1 w2 w3 W250 w299 unknown w1"), (2, "copied TEXT"), (3, None), (4, "nothing-here"), (5, "straße été"), (1, "w1 w2 w3 W250 w299 unknown w1"), (6, " ".join(f"w{i}" for i in range(0, 300, 2))), (None, "w7 w8")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    for k in (5, 50):
        got = defaultdict(list)
        for r in rank(docs, items, k).collect():
            got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
        expected = {i: [(at + 1, *x) for at, x in enumerate(scores_by_hand([r[:2] for r in rows], t)[:k])] for i, t in asked}
        assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in expected.items() if x}


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 500, 0, 3000, 7]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    places = np.concatenate([np.sort(rng.choice(1 << 14, n, replace=False)) for n in sizes]).astype(np.int64)
    for impacts in (rng.integers(1, 10**6, len(places)), np.full(len(places), 5), np.arange(len(places)) % 3):
        t = Treaps(starts, places, impacts)
        for i, n in enumerate(sizes):
            if not n:
                assert t.root[i] == -1
                continue
            seen, deepest, stack = [], 0, [(t.root[i], -1, 1 << 14, 10**9, 1)]
            while stack:
                at, lo, hi, above, depth = stack.pop()
                if at >= 0:
                    assert lo < places[at] < hi and impacts[at] <= above
                    seen.append(at)
                    deepest = max(deepest, depth)
                    stack += [(t.left[at], lo, places[at], impacts[at], depth + 1), (t.right[at], places[at], hi, impacts[at], depth + 1)]
            assert sorted(seen) == list(range(starts[i], starts[i + 1])) and deepest <= 12 * math.log2(n + 2)


def test_traversal_prunes_and_loses_nothing():
    rng = np.random.default_rng(2)
    n, terms, k = 4000, 6, 10
    held = [np.sort(rng.choice(n, size, replace=False)) for size in (3000, 2000, 800, 200, 50, 5)]
    impacts = [rng.integers(1, 1000, len(x)) ** 2 for x in held]
    t = Treaps(np.concatenate([[0], np.cumsum([len(x) for x in held])]), np.concatenate(held).astype(np.int64), np.concatenate(impacts))
    ids, weights = np.arange(n) * 3, np.array([1, 2, 3, 5, 8, 13])
    total = np.zeros(n, np.int64)
    for x, i, w in zip(held, impacts, weights, strict=True):
        total[x] += w * i
    best = Best(k)
    scored = best_of_shard(t, t.root, weights, ids, best)
    order = np.lexsort((ids, -total))[:k]
    assert best.doc.tolist() == ids[order].tolist() and best.score.tolist() == total[order].tolist()
    assert scored < (total > 0).sum() / 2 and terms == len(weights)


def test_statistics_of_the_index(docs, rows):
    index = build_index(docs)
    n, length, holding = statistics(index, [b"w1", "straße".encode(), b"missing"])
    split = [set(terms_of(r[1])) for r in rows]
    assert (n, length) == (sum(map(bool, split)), sum(len(terms_of(r[1])) for r in rows))
    assert holding == {t: sum(t in s for s in split) for t in (b"w1", "straße".encode())}


def tree_by_hand(leaves):
    """(root, proof of each leaf as a list of (left, right) by level)."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            first = i // 16 * 16
            path.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def test_traversal_of_a_block():
    rng = random.Random(1)
    for n in (1, 2, 16, 17, 255, 256, 257, 300, 4095, 4096):
        leaves = [f"{rng.random():.15f}" for _ in range(n)]
        root, paths = tree_by_hand(leaves)
        assert block_root(leaves, True) == root
        assert list(traverse(leaves, True)) == paths
    # a block that is not all: always all levels, those of a single node included
    for n in (1, 40):
        path = next(iter(traverse([str(i) for i in range(n)], False)))
        assert len(path) == merkle.LEVELS
        assert merkle._fold("0", path) == block_root([str(i) for i in range(n)], False)


def manifest_by_hand(rows, tampered):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda values: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by_source = defaultdict(list)
    for doc, text, source, lang, n in rows:
        by_source[source].append((doc, leaf((doc, source, lang, n, text)), leaf((doc, source, lang, n, lower(text)))))
    trees, out = {}, []
    for source, x in by_source.items():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = tree_by_hand([r[1] for r in x])
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = tree_by_hand([trees[s][0] for s in sources])
    for source, top in zip(sources, tops, strict=True):
        for (doc, own, other), path in zip(by_source[source], trees[source][1], strict=True):
            whole = path + top
            folded = merkle._fold(other if tampered(doc) else own, whole)
            out.append((doc, own, trees[source][0], root, h(*(a + b for a, b in whole)), folded, folded == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def odd_crc(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_manifest(docs, rows, monkeypatch, few):
    monkeypatch.setattr(merkle, "FEW", few)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = Counter(tuple(r[c] for c in COLUMNS) for r in manifest(docs, tampered).collect())
    expected = Counter(manifest_by_hand([r[:5] for r in rows], odd_crc))
    assert got == expected and len({r[-1] for r in got}) == 2
    assert manifest(docs).filter("verified").count() == len(rows)


def test_manifest_over_several_tiers(spark):
    """Blocks on three tiers, and more sources than a block holds."""
    n = 300
    many = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("T").alias("text"), F.when(F.col("id") < n, F.concat(F.lit("s"), F.col("id").cast("string"))).otherwise("big").alias("source"), F.lit(None).cast("string").alias("lang"), F.col("id").cast("int").alias("n_chars"))
    got = Counter(tuple(r[c] for c in COLUMNS) for r in manifest(many, F.col("doc_id") % 2 == 0).collect())
    rows = [(i, "T", f"s{i}" if i < n else "big", None, i) for i in range(9000)]
    assert got == Counter(manifest_by_hand(rows, lambda i: i % 2 == 0))


def test_manifest_with_small_blocks(docs, rows):
    got = Counter(tuple(r[c] for c in COLUMNS) for r in manifest(docs, levels=1).collect())
    assert got == Counter(manifest_by_hand([r[:5] for r in rows], lambda _: False))


def test_nothing_and_one_row(spark, docs):
    empty, one = docs.filter("false"), docs.filter("source = 'lone'")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert decode_ids(encode_ids(empty)).count() == 0
    assert rank(empty, items).count() == 0 and rank(docs, items.filter("false")).count() == 0
    assert manifest(empty).count() == 0
    row = manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["verified"] and row["proof_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_merkle"])
def test_sql_twins(spark, folder, name):
    out = QUERIES[name](spark, folder)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(out.columns)
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(cursor.fetchall())
