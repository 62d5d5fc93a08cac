"""Every operator against brute force, on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agromix.llm.common import skew_safe_lookup
from agromix.llm.exact_dedup import RadixTrie, classes, exact_dedup
from agromix.llm.licenses import NOTICES, PHRASES, TEXTS, scan_licenses, scan_text, template_index
from agromix.llm.line_dedup import line_dedup
from agromix.llm.near_dedup import alignment, components, near_classes, order_minhash, shingles
from agromix.llm.packing import CapacityTree, best_fit, close_windows, pack
from agromix.llm.pieces import Pieces, decode, encode_merged, encode_nbest, model_file
from agromix.llm.rules import base_statistics, quality_rules
from agromix.llm.token_counts import count_tokens, dealt_blocks, token_files, write_token_files
from agromix.llm.tokens import SEPARATOR, encode_bytes, rank_file
from agromix.llm.toxicity import LabelModel, fit_label_model, fit_toxicity, held_out, score_toxicity
from agromix.llm.warc import parse_record, read_warc, record_bytes, write_warc

SCHEMA = "doc_id long, text string, lang string, kept string, ID string, _row string, key string, score string"


def words(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = words(rng, 300, 5000)
    long = "\n".join(words(rng, 40, 5000) for _ in range(2000))
    texts = [None, "", "   \n\t", "one", "Same line here\nother\nsame LINE here \n", "x\nSAME line here", "Étude de ligne\nétude de ligne", "ÉTUDE DE LIGNE", base, base + " tail", base.replace("w1", "v1"), long, long + " end", words(rng, 30, 9), "two words", "two  words"]
    texts += [words(rng, rng.randrange(1, 200), 3000) for _ in range(60)] + ["a hot text that many documents share\nwith a second line"] * 40
    out = [(i, t, None if i % 3 else "en", "yes", "i", None, "k", "s") for i, t in enumerate(texts)]
    return [*out, out[8], (None, "no identifier", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(len(rows))] + [(3, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")


def test_radix_trie_with_and_without_eviction():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(3000)]
    expected = {s: (min(i for i, t in enumerate(strings) if t == s), strings.count(s)) for s in set(strings)}
    for budget in (1 << 40, 20_000):
        trie, away = RadixTrie(), defaultdict(list)
        for i, s in enumerate(strings):
            if trie.insert(s, i) is not None:
                away[s].append((i, 1))
            while trie.held > budget and trie.strings > 1:
                prefix, strings = trie.evict()
                found = list(strings)
                assert all(s.startswith(prefix) for s, _, _ in found)
                for s_, best, n in found:
                    away[s_].append((best, n))
        for s, best, n in trie.items():
            away[s].append((best, n))
        assert {s: (min(b for b, _ in x), sum(n for _, n in x)) for s, x in away.items()} == expected


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    pick = max if keep == "max" else min
    for budget in (192 << 20, 30_000):
        got = exact_dedup(docs, keep=keep, budget=budget).collect()
        assert len(got) == len(rows)
        for r in got:
            ids = groups[r["text"] or ""]
            best = pick((x for x in ids if x is not None), default=None)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(ids), r["doc_id"] == best)
            assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
            assert r["ID"] == (None if r["doc_id"] is None else "i")


def test_line_dedup(docs, rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(strip))
    first = {}
    for r in rows:
        if r[0] is not None:
            for line in (r[1] or "").split("\n"):
                if len(key(line)) >= 10:
                    first[key(line)] = min(first.get(key(line), r[0]), r[0])
    for r in line_dedup(docs).collect():
        lines = (r["text"] or "").split("\n")
        left = [x for x in lines if r["doc_id"] is None or first.get(key(x), r["doc_id"]) >= r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (len(lines), len(lines) - len(left), "\n".join(left))


def test_line_dedup_over_several_words_of_the_bitmap(spark):
    shared = [f"shared line {i}" for i in range(300)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(x for pair in zip(shared, (f"own line number {i}" for i in range(300)), strict=True) for x in pair))]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["n_dropped"] == 300 and got[2]["kept_text"] == "\n".join(f"own line number {i}" for i in range(300))
    assert got[1]["n_dropped"] == 0 and got[1]["keep_bitmap"] is None


def brute_statistics(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(found) - 7):
        windows[tuple(found[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_statistics(spark, docs, labels):
    rng = random.Random(2)
    repeated = " ".join(words(rng, 10) + " the same eight words come here once more " for _ in range(5))
    more = spark.createDataFrame([(1000, repeated), (1001, "a b c d e f g h " * 3), (1002, "|||\n***\n\n***\n ** $\n"), (1003, "x y z " * 40)], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    for r in quality_rules(both, labels).collect():
        n, chars, symbols, dup, repeats = brute_statistics(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeats)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_reject_what_labels_call_bad(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 60) if i % 3 else " ".join(w + "%%%" for w in words(rng, 60).split())) for i in range(240)]
    known = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)


def test_tokens_equal_those_of_the_library(folder, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[0] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += ["", " ", "a", " lead", "trail ", "a  b", "a   b\n\n c", "tab\tx y", "don't we'll 12 3", "x y z", "　a b", "line\n next \nlast", "é à b"]
    for text in texts:
        assert np.frombuffer(encode_bytes(text, rank_file()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_capacity_tree_and_best_fit():
    rng = random.Random(4)
    for _ in range(30):
        tree, held = CapacityTree(64), Counter()
        for _ in range(60):
            capacity = rng.randrange(1, 65)
            tree.add(capacity, 1)
            held[capacity] += 1
            need = rng.randrange(1, 65)
            assert tree.tightest(need) == min((c for c in held if held[c] and c >= need), default=None)
    lengths = [rng.randrange(1, 65) for _ in range(400)]
    windows = best_fit(lengths, 64)
    assert sorted(i for w in windows for i in w) == list(range(400)) and all(sum(lengths[i] for i in w) <= 64 for w in windows)
    closed = close_windows([[(i, 0, lengths[i]) for i in w] for w in windows], 64)
    sizes = [sum(x[2] for x in w) for w in closed]
    assert sum(sizes) == sum(lengths) and all(s == 64 or s & (s - 1) == 0 for s in sizes)


def test_packing(docs, rows):
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(encode_bytes(r[1] or "", rank_file()) + bytes(4))
    got = pack(docs, held_tokens=20_000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        ids = texts[r["doc_id"]][0]
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) and r["doc_tokens"] == len(ids) // 4
    assert set(by_doc) == set(texts)
    for one, pieces in by_doc.items():
        covered = Counter(i for p in pieces for i in range(p["start"], p["start"] + p["length"]))
        assert covered == Counter({i: len(texts[one]) for i in range(len(texts[one][0]) // 4)})
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 1024 or (at < 1024 and at & (at - 1) == 0)


def test_warc(spark):
    body = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "http://a/\r\nb", body), (3, None, body), (9, "u", body), (4, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (3, "u", body), (None, "u", body)] + [(100 + i, "u", f"{i}" * 150) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = write_warc(pages)
    assert index.columns == ["archive", "offset", "length", "url", "digest"]
    read = read_warc(spark, index, stretch=700, gap=10, most=900)
    assert read.select(F.spark_partition_id()).distinct().count() > 3  # tasks follow the bytes that the index points at
    got = read.collect()
    assert len(got) == len(rows)
    found = Counter((r["id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got)
    expected = Counter()
    for one, _, html in rows:
        data = (html or "").encode()
        smallest = min((i for i, _, h in rows if h == html and i is not None), default=None)
        revisit = len(data) >= 100 and one != smallest
        expected[(one, "revisit" if revisit else "response", smallest if revisit else None, len(data), hashlib.sha256(data).hexdigest())] += 1
    assert found == expected
    assert all(bytes(r["payload"]).decode() in {h or "" for _, _, h in rows} for r in got if r["record_type"] == "response")
    some = index.orderBy("digest").limit(7)
    assert read_warc(spark, some).count() == 7
    with pytest.raises(ValueError, match="damaged"):
        parse_record(record_bytes(1, "u", b"payload", "0" * 64, None, False))
    assert gzip.decompress(gzip.compress(b"x", 4, mtime=0)) == b"x"


def brute_shingles(text):
    found = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    found = [bytes(x + 32 if 65 <= x <= 90 else x for x in w) for w in (w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))]
    grams = [tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))] if found else []
    seen, out = Counter(), []
    for g in grams:
        seen[g] += 1
        out.append((g, seen[g]))
    return out


def brute_similarity(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1] / (len(a) + len(b) - last[-1]) if a and b else 0.0


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(60):
        a = words(rng, rng.randrange(1, 80), 8 if rng.random() < 0.3 else 1000).split()
        b = list(a)
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = "new"
        if rng.random() < 0.3:
            b = b[len(b) // 4 :] + b[: len(b) // 4]
        expected = brute_similarity(" ".join(a), " ".join(b))
        got = alignment(shingles(" ".join(a).encode()), shingles(" ".join(b).encode()))
        assert got == pytest.approx(expected if expected >= 0.8 else 0.0)
    assert len(shingles(b"  \n")) == 0 and len(shingles(b"one two")) == 1
    big = ("word " * 400_000).encode()
    assert len(np.unique(shingles(big))) == 399_996
    assert (order_minhash(shingles(b"a b c d e f g h i")) == order_minhash(shingles(b"A B c d e f g h I"))).all()


@pytest.mark.parametrize(("rounds", "held"), [(0, 256), (0, 4), (1, 256)])
def test_near_classes(spark, rounds, held):
    rng = random.Random(7)
    texts = {}
    chain = words(rng, 120, 100_000).split()
    for k in range(40):  # a drifting text: neighbours are near, distant ones are not
        chain[(7 * k) % 120] = f"drift{k}"
        texts[len(texts)] = " ".join(chain)
    for g in range(12):
        base = words(rng, 150, 100_000).split()
        for k in range(rng.choice((1, 2, 5, 30 if g == 0 else 3))):
            copy = list(base)
            for _ in range(k % 4):
                copy[rng.randrange(len(copy))] = "edit"
            texts[len(texts)] = " ".join(copy)
    texts |= {500: None, 501: "", 502: "a b", 503: "A  b", 504: texts[0], 505: " "}
    long = words(rng, 30_000, 1_000_000)
    texts |= {506: long, 507: long + " end"}
    rows = [(one, text, 1, "k", "r") for one, text in [*texts.items(), (None, "nobody"), (504, texts[0])]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id int, keys string, rep string").repartition(4)
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i in keys:
        for j in keys:
            if i < j < 506 and ((texts[i] or "") == (texts[j] or "") or brute_similarity(texts[i], texts[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    parent[507] = 506
    got = near_classes(frame, rounds=rounds, held=held).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["class_id"] == (None if r["id"] is None else root(r["id"]))
        assert r["kept"] == (r["id"] == r["class_id"])


def one_repeats(rng, n):
    """A text without a repeated shingle, and near copies of it that repeat some."""
    base = words(rng, n, 1_000_000).split()
    at = rng.randrange(n // 2)
    doubled = base[: at + 6] + base[at : at + 6] + base[at + 6 :]
    cut = doubled[:at] + doubled[at + 6 :]
    thrice = base[: at + 6] + 2 * base[at : at + 6] + base[at + 6 :]
    return [" ".join(x) for x in (base, doubled, thrice, [*cut[:-1], "edit"])]


def test_alignment_where_one_text_repeats_a_shingle():
    rng = random.Random(16)
    for n in (60, 90, 200, 400):
        texts = one_repeats(rng, n)
        found = [shingles(x.encode()) for x in texts]
        assert [len(np.unique(x)) for x in found] == [len(x) for x in found]
        assert [len(x) - len(set(g for g, _ in brute_shingles(t))) > 0 for x, t in zip(found, texts)] == [False, True, True, False]
        for i in range(4):
            for j in range(4):
                expected = brute_similarity(texts[i], texts[j])
                assert alignment(found[i], found[j]) == pytest.approx(expected if expected >= 0.8 else 0.0)
                assert n < 200 or (expected > 0.8 and (order_minhash(found[i]) == order_minhash(found[j])).any())


def test_near_classes_where_one_text_repeats_a_shingle(spark):
    rng = random.Random(17)
    rows = [(4 * g + k, text) for g in range(10) for k, text in enumerate(one_repeats(rng, 300))]
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["id"]: (r["class_id"], r["group_size"]) for r in got} == {i: (i // 4 * 4, 4) for i, _ in rows}


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    edges = [(1, 2), (3, 2), (4, 3), (10, 11), (12, 11), (12, 13), (20, 20), *((100 + i, 101 + i) for i in range(40))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect() if r["node"] != 20}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 13: 10, **{100 + i: 100 for i in range(41)}}


def test_toxicity(spark):
    rng = random.Random(8)
    rows, known = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        text = words(rng, 80).split()
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            text[rng.randrange(80)] = rng.choice(("vilexyz", "awfulabc", "zogling", "zogster", "zogman"))
        rows.append((i, " ".join(text)))
        known.append((i, int(toxic != (rng.random() < 0.03))))
    frame = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    model = fit_toxicity(frame, spark.createDataFrame(known, "doc_id long, toxic int"))
    got = score_toxicity(frame, model).withColumn("h", held_out()).collect()
    truth = {i: int(any(w.startswith("zog") or w in ("vilexyz", "awfulabc") for w in t.split())) for i, t in rows}
    tested = [r for r in got if r["h"] and r["doc_id"] < 5000]
    assert len(tested) > 200 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in tested]) > 0.97
    assert {r["predicted"] for r in got if r["doc_id"] >= 5000} == {0}
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def planted_votes(rng, n, rates, prior, labelled):
    """Votes of independent voters by class, the true class, and a label on some rows that is wrong in one of thirty."""
    truth = rng.random(n) < prior
    cast = rng.random((n, len(rates))) < np.where(truth[:, None], [t for t, _ in rates], [c for _, c in rates])
    label = np.where(rng.random(n) < labelled, (truth ^ (rng.random(n) < 1 / 30)).astype(float), np.nan)
    return truth, cast.astype(float), label


def vote_rows(spark, cast, label):
    rows = [(list(map(int, np.flatnonzero(v))), None if np.isnan(y) else int(y), 1) for v, y in zip(cast, label)]
    return spark.createDataFrame(rows, "voters array<int>, label int, n long")


def log_likelihood(model, cast, label):
    """Of votes and labels, row by row and voter by voter, both classes written out."""
    total = 0.0
    for v, y in zip(cast, label):
        of = []
        for prior, shares, right in ((model.prior, model.on_toxic, 1.0), (1 - model.prior, model.on_clean, 0.0)):
            p = prior
            for vote, share in zip(v, shares):
                p *= share if vote else 1 - share
            of.append(p * (1 if np.isnan(y) else model.trust if y == right else 1 - model.trust))
        total += math.log(sum(of))
    return total


def test_label_model_recovers_planted_voters(spark):
    rates = [(0.6, 0.02), (0.4, 0.01), (0.5, 0.05), (0.3, 0.02), (0.03, 0.4)]
    truth, cast, label = planted_votes(np.random.default_rng(5), 4000, rates, 0.2, 0.2)
    for_toxic = np.array([True] * 4 + [False])
    start = LabelModel(0.4, np.array([0.4] * 4 + [0.1]), np.array([0.1] * 4 + [0.4]), np.eye(5))
    rows = vote_rows(spark, cast, label)
    model = fit_label_model(rows, start, for_toxic, rounds=30)
    assert abs(model.prior - 0.2) < 0.02
    assert np.abs(model.on_toxic - [t for t, _ in rates]).max() < 0.05 and np.abs(model.on_clean - [c for _, c in rates]).max() < 0.02
    assert np.array_equal(model.overlap, np.eye(5))  # independent voters share nothing
    # every step of expectation maximisation raises the likelihood; the posterior is Bayes' rule
    steps = [log_likelihood(m, cast, label) for m in (start, fit_label_model(rows, start, for_toxic, rounds=1), fit_label_model(rows, start, for_toxic, rounds=3), model)]
    assert all(b > a - 0.5 for a, b in zip(steps, steps[1:])) and steps[-1] > steps[0] + 50  # but for the half votes that smooth the shares
    for v in cast[:50]:
        a = model.prior * np.prod(np.where(v > 0, model.on_toxic, 1 - model.on_toxic))
        b = (1 - model.prior) * np.prod(np.where(v > 0, model.on_clean, 1 - model.on_clean))
        assert abs(1 / (1 + np.exp(-model.odds(v[None])[0])) - a / (a + b)) < 1e-9
    told = ~np.isnan(label)
    found = model.calibrated(cast[told], label[told])
    assert abs(found.trust - 29 / 30) < 0.02 and abs(found.slope - 1) < 0.5
    # voters that are sure overrule a wrong label, and the model is nearer to the truth than the labels
    assert ((found.posterior(cast[told], label[told]) > 0.5) == truth[told]).mean() > (label[told] == truth[told]).mean()


def test_label_model_lets_copies_of_a_voter_count_once(spark):
    rates = [(0.5, 0.05), (0.5, 0.05), (0.5, 0.05)]
    truth, cast, label = planted_votes(np.random.default_rng(6), 4000, rates, 0.3, 0.3)
    cast = np.column_stack([cast, cast[:, :1], cast[:, :1], cast[:, :1]])  # one voter four times
    start = LabelModel(0.3, np.full(6, 0.4), np.full(6, 0.1), np.eye(6))
    model = fit_label_model(vote_rows(spark, cast, label), start, np.full(6, True))
    same = model.overlap[np.ix_([0, 3, 4, 5], [0, 3, 4, 5])]
    assert same.min() > 0.95 and model.overlap[1, 2] < 0.15
    gains = model.odds(np.array([[1, 0, 0, 1, 1, 1], [0, 1, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0]], float))
    assert abs((gains[0] - gains[2]) - (gains[1] - gains[2])) < 1.0


def test_toxicity_learns_from_texts_without_labels(spark):
    """Voters vote on texts that nobody labelled; ties, repeats, nulls and very long texts score as their words say."""
    rng = random.Random(9)
    rows = []
    for i in range(900):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randrange(20, 60))]
        if i % 4 == 0:
            for bad in rng.sample(["grobian", "scoundrel", "wretch", "lout"], rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (903, "alpha beta " * 60_000), (904, "scoundrel wretch grobian lout " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900) if i % 3], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    assert len(model.voters) >= 4 and model.label_model.trust > 0.9
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(900))
    assert got[0]["score"] == got[902]["score"] and got[900]["score"] == got[901]["score"] < 0.5
    assert got[903]["predicted"] == 0 and got[904]["predicted"] == 1


def test_toxicity_never_reads_held_out_labels(spark):
    rows = spark.createDataFrame([(i, words(random.Random(i), 30)) for i in range(300)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    flipped = known.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (score_toxicity(rows, fit_toxicity(rows, x, least=2)).orderBy("doc_id").collect() for x in (known, flipped))
    assert a == b


def test_piece_search_against_all_segmentations():
    pieces = Pieces(model_file())

    def every(word):
        out = []

        def walk(i, ids, score):
            if i == len(word):
                out.append((score, tuple(ids)))
                return
            known = False
            for j in range(i + 1, len(word) + 1):
                if (found := pieces.score.get(word[i:j])) is not None:
                    known = known or j == i + 1
                    walk(j, [*ids, found[0]], score + found[1])
            if not known:
                raw = [pieces.bytes[b] for b in word[i].encode()]
                walk(i + 1, [*ids, *raw], score + pieces.lost)

        walk(0, [], 0.0)
        return sorted(out, key=lambda x: -x[0])

    for word in ("▁hello", "▁étude", "▁aaaa", "▁x\ny", "▁☃z", "▁", "▁▁ab"):
        all_ = every(word)
        got = pieces.search(word, 5)
        assert np.allclose([s for s, _ in got], [s for s, _ in all_[:5]]) and len(set(got)) == len(got)
        assert all(any(ids == x for _, x in all_) for _, ids in got)
    for text in ("ab cde", "a  b", "x ", " x", "q\nr st"):
        all_ = every("▁" + text.replace(" ", "▁"))
        got = pieces.nbest(text, 4)
        assert np.allclose([s for s, _ in got], [s for s, _ in all_[:4]])
        for _, ids in got:
            assert pieces.text(np.frombuffer(ids, "<i4").tolist()) == text


def test_pieces_of_many_words_equal_those_of_the_queue(monkeypatch):
    from agromix.llm import pieces as module

    pieces, rng = Pieces(model_file()), random.Random(4)
    names = [p for p, _, _ in pieces.scored if "▁" not in p]
    found = sorted({" " * rng.randrange(1, 3) + "".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(400)} | {" ", "   ", " ☃𝔘é\n", " " + "abc" * 40, " \x00x", " aaaaaaaa"})
    for n in (1, 2, 5):
        got = pieces.segment(found, n)
        for word in found:
            expected = pieces.search(word.replace(" ", "▁"), n)
            scores = got.score[got.rows[word]]
            assert scores[: len(expected)] == pytest.approx([s for s, _ in expected]) and (scores[len(expected) :] == -np.inf).all()
            paths = [tuple(got.path(word, k)) for k in range(len(expected))]
            assert len(set(paths)) == len(paths) and all(pieces.text(p) == word[1:] for p in paths)
            # equal scores may stand in any order, all others as in the queue
            assert {p for p, s in zip(paths, scores, strict=False) if s > expected[-1][0] + 1e-9} == {p for s, p in expected if s > expected[-1][0] + 1e-9}
    # every path of every word has left a queue piece by piece
    pieces.known.clear()
    pieces.pops = 0
    short = [w for w in found if len(w) <= 64]
    got = pieces.segment(short, 5)
    several = [w for w in short if got.score[got.rows[w], 1] > -np.inf]
    assert pieces.pops >= sum(6 for _ in several) and len(several) > 300
    monkeypatch.setattr(module, "MEMO", 50)
    before = [x["ids"] for x in pieces.encode(pa.array([" ".join(w.strip() for w in found)]), 5)[0].as_py()]
    assert len(pieces.segments(5).rows) == 50
    assert before == [x["ids"] for x in pieces.encode(pa.array([" ".join(w.strip() for w in found)]), 5)[0].as_py()]


def test_pieces_and_the_library(docs, rows):
    pieces = Pieces(model_file())
    texts = [r[1] or "" for r in rows]
    merged = {r["doc_id"]: r["ids"] for r in encode_merged(docs).collect()}
    for r in rows:
        assert merged[r[0]] == pieces.library.encode(r[1] or "")
    ids = [pieces.library.encode(t) for t in texts] + [None, [3 + 0xFF, 300], []]
    got = pieces.texts(pa.array(ids, pa.list_(pa.int32())).slice(2)).to_pylist()
    assert got == [*texts[2:], None, pieces.text([3 + 0xFF, 300]), ""]
    for text in texts[:20]:  # the best path scores at least what the merges give
        if pieces.library.unk_id() not in (own := pieces.library.encode(text)) and not any(pieces.library.is_byte(i) for i in own):
            assert pieces.nbest(text, 1)[0][0] >= sum(pieces.library.get_score(i) for i in own) - 1e-6


def test_piece_round_trip(docs, rows):
    best = encode_nbest(docs, 3).select("doc_id", F.col("nbest")[0]["ids"].alias("ids"), F.size("nbest").alias("n"))
    got = Counter((r["doc_id"], r["text"]) for r in decode(best).collect())
    assert got == Counter((r[0], r[1] or "") for r in rows)


def test_token_counts(docs, rows):
    written = write_token_files(docs)
    assert dealt_blocks(token_files(written), 100).rdd.getNumPartitions() > 10
    for block in (7, 2 << 20):
        files = token_files(written)
        got = count_tokens(files, block_tokens=block, a_task=20_000 if block == 7 else 8).join(written, ["file", "ordinal"]).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["complete"]) for r in got) == Counter((r[0], len(encode_bytes(r[1] or "", rank_file())) // 4, True) for r in rows)
        if block == 7:
            continue
        by_file = defaultdict(list)
        for r in got:
            by_file[r["file"]].append((r["start"], r["start"] + r["n_tokens"]))
        for spans in by_file.values():
            spans.sort()
            assert len(spans) and spans[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_unfinished_and_empty_documents(spark, tmp_path):
    path = tmp_path / "t.bin"
    np.array([9, 9, 5, 9, 1, 2, 3], dtype="<u2").tofile(path)
    (tmp_path / "none.bin").write_bytes(b"")
    named = spark.createDataFrame([(str(path),), (str(tmp_path / "none.bin"),)], "file string")
    for block in (1, 2, 3, 100):
        got = count_tokens(token_files(named), end=9, block_tokens=block).orderBy("ordinal").collect()
        assert [(r["ordinal"], r["start"], r["n_tokens"], r["complete"]) for r in got] == [(0, 0, 0, True), (1, 1, 0, True), (2, 2, 1, True), (3, 4, 3, False)]


def test_licenses(spark):
    rng = random.Random(9)
    rows, expected, possible, templates = [], set(), set(), NOTICES | TEXTS
    for i in range(200):
        text = words(rng, rng.randrange(0, 200)).split()
        for name in rng.sample(sorted(templates), rng.randrange(3)):
            at, notice = rng.randrange(len(text) + 1), (templates[name].upper() if rng.random() < 0.5 else templates[name]).split()
            for _ in range(rng.randrange(4)):  # edited notices
                notice[rng.randrange(len(notice))] = "other"
            text[at:at] = notice
        rows.append((i, " ".join(text)))
    rows += [(200, words(rng, 30_000) + " " + TEXTS["MIT-text"] + " " + words(rng, 20_000)), (201, rows[3][1]), (3, rows[3][1])]
    index = template_index(templates)
    clean = lambda t: re.sub(rb"[^a-z0-9\x80-\xff]", b" ", t.encode().lower()).split()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i, text in rows:
        for name, template in templates.items():
            own, t = clean(text), grams(clean(template))
            if not t & grams(own):
                continue
            size = 1 << (len(t) - 1).bit_length()
            s = [tuple(own[k : k + 5]) for k in range(len(own) - 4)]
            share = lambda w, n: len(t & set(s[w : w + n])) / len(t)  # noqa: B023, E731
            if any(share(w, size) >= 0.8 for w in range(len(s))):
                expected.add((i, name))  # stretches of the class's size, wherever they begin, are always found
            if any(share(w, 2 * size) >= 0.8 for w in range(len(s))):
                possible.add((i, name))
    more = [(*r, "lang", 1) for r in [*rows, (None, None), (999, "")]]
    got = scan_licenses(spark.createDataFrame(more, "doc_id long, text string, license string, n_words int"), templates).collect()
    found = Counter((r["doc_id"], r["license"]) for r in got)
    assert expected <= set(found) <= possible and len(expected) > 100
    assert all(n == sum(r[0] == one for r in rows) for (one, _), n in found.items())
    assert all(0.8 <= r["containment"] <= 1 for r in got)
    assert scan_text("released UNDER the (MIT) license", index)[0][:2] == ("MIT", 1.0)
    with pytest.raises(ValueError, match="five words"):
        template_index({"x": "too short"})


def test_empty_tables(spark, empty, labels):
    no_pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert exact_dedup(empty).count() == 0
    assert line_dedup(empty).count() == 0
    assert quality_rules(empty, labels).count() == 0
    assert pack(empty).count() == 0
    assert near_classes(empty).count() == 0
    assert score_toxicity(empty, fit_toxicity(empty, labels)).count() == 0
    assert encode_nbest(empty).count() == 0
    assert scan_licenses(empty).count() == 0
    written = write_token_files(empty)
    assert count_tokens(token_files(written)).count() == 0
    assert read_warc(spark, write_warc(no_pages)).count() == 0


def test_without_labels(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_toxicity(docs, fit_toxicity(docs, none)).filter("predicted = 1").count() == 0
    got = quality_rules(docs, none).collect()
    assert len(got) == len(rows) and all(r["kept"] != r["base_failed"] for r in got)


def test_other_columns_pass_through(docs, labels):
    for made in (exact_dedup(docs), line_dedup(docs), quality_rules(docs, labels), score_toxicity(docs, fit_toxicity(docs, labels))):
        assert {"ID", "_row", "key", "lang"} <= set(made.columns)
        assert made.filter("ID = 'i'").count() == docs.filter("ID = 'i'").count()


def test_lookup_with_hot_keys(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 50}") for i in range(4000)] + [(None, None)], "id long, key string")
    right = left.groupBy("key").agg(F.count("*").alias("n")).filter("key is not null").withColumn("v", F.concat(F.lit("v"), "key"))
    got = skew_safe_lookup(left, right, "key", "n", "id").collect()
    assert len(got) == 4001 and all(r["v"] == (None if r["key"] is None else "v" + r["key"]) for r in got)


def test_statistics_keep_their_rows(docs):
    assert base_statistics(docs.select("doc_id", "text")).count() == docs.count()
    assert classes(docs).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_license_notices_close_together_are_counted_each():
    index = template_index(NOTICES)
    for name, text in NOTICES.items():
        n = len(re.findall(r"[A-Za-z0-9]+", text))
        for copies in (1, 2, 3, 12, 40):
            for between in (" ", " and then ", "\n" + "other words stand here " * 40):
                found = {x[0]: x for x in scan_text("Before it. " + between.join([text] * copies) + " After it.", index)}
                assert found[name] == (name, 1.0, 2, n, copies)
    gpl = NOTICES["GPL-3.0"]
    part = " ".join(gpl.split()[6:])
    assert {x[0]: x for x in scan_text(f"{part} {gpl} {gpl}", index)}["GPL-3.0"][1:] == (1.0, 6, 12, 2)


def test_license_bodies_and_phrases(spark, folder):
    names = [*TEXTS, *PHRASES]
    rows = [(i, f"Some words before.\n{(TEXTS | PHRASES)[x]}\nAnd words after.") for i, x in enumerate(names)]
    rows += [(900, "all  RIGHTS\nreserved"), (901, "all rights are reserved"), (902, "All rights"), (903, "x All rights reserved. All rights reserved."), (904, "SPDX-License-Identifier: CC-BY-SA-4.0")]
    got = defaultdict(dict)
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]][r["license"]] = (r["containment"], r["first_word"], r["n_words"], r["n_notices"])
    for i, x in enumerate(names):
        assert got[i][x] == (1.0, 3, len(re.findall(r"[A-Za-z0-9]+", (TEXTS | PHRASES)[x])), 1)
    assert got[900] == {"All-rights-reserved": (1.0, 0, 3, 1)} and got[903] == {"All-rights-reserved": (1.0, 1, 3, 2)}
    assert 901 not in got and 902 not in got and set(got[904]) == {"SPDX-CC-BY-SA-4.0"}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = {r["doc_id"] for r in docs.select("doc_id", "text").collect() if re.search(r"(?<![a-z0-9\x80-\U0010ffff])all[^a-z0-9\x80-\U0010ffff]+rights[^a-z0-9\x80-\U0010ffff]+reserved(?![a-z0-9\x80-\U0010ffff])", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))}
    assert {r["doc_id"] for r in scan_licenses(docs).filter("license = 'All-rights-reserved'").collect()} == expected


def test_added_token_in_texts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from agromix.llm.queries import QUERIES

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = "<|endoftext|>"
    texts = [e, f"a {e} b", f"a{e}b", f"{e}{e} x  y", f"one two\n{e}", "<|endoftext |>", f"é {e}é ", f" {e} ", "plain words"]
    expected = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(x.count(50256) for x in expected) == sum(x.count(e) for x in texts)
    for text, ids in zip(texts, expected, strict=True):
        assert np.frombuffer(encode_bytes(text, rank_file()), "<u4").tolist() == ids
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op2_token_counts"](spark, str(tmp_path)).collect()}
    assert got == {i: len(x) for i, x in enumerate(expected)}
    for r in QUERIES["op6_packing"](spark, str(tmp_path)).collect():
        ids = np.array([*expected[r["doc_id"]], 0], dtype="<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for end in (50256, SEPARATOR):
        written = write_token_files(frame, end=end)
        assert count_tokens(token_files(written), end=end).count() == len(texts)
