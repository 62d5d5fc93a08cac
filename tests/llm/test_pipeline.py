import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def planted():
    """Texts with copies, near copies, long ones, and cases at the edge; (doc_id, text)."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(5000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    texts = [prose(rng.randrange(30, 200)) for _ in range(30)]
    rows = list(enumerate(texts))
    for k in range(6):
        base = texts[k].split()
        rows += [(100 + 10 * k, texts[k]), (101 + 10 * k, texts[k])]
        base[len(base) // 2] = "changed"
        rows.append((102 + 10 * k, " ".join(base)) if len(base) > 100 else (102 + 10 * k, texts[k]))
    long = prose(40_000)
    return [*rows, (500, long), (501, long), (502, None), (503, ""), (504, "one"), (None, texts[0]), (None, None), rows[3], rows[3]]


def test_stages_against_brute_force(spark, folder):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    exact = [(r["doc_id"], r["text"]) for r in stages["exact_dedup"](spark, docs, folder).collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    smallest = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = sorted((i, t or "") for i, t in rows if i == smallest[t or ""])
    assert sorted((i, t or "") for i, t in exact) == expected

    kept = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in exact], docs.schema)
    near = {r["doc_id"] for r in stages["near_dedup"](spark, kept, folder).collect()}

    def similar(a, b):
        shingles = lambda t: [tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)]
        x, y = set(shingles(a)), set(shingles(b))
        return bool(x and y) and len(x & y) / len(x | y) >= 0.8

    small = sorted((i, t or "") for i, t in exact if len(t or "") < 10_000)
    gone = {j for n, (i, a) in enumerate(small) for j, b in small[n + 1 :] if i != j and similar(a, b)}
    assert near == {i for i, _ in exact} - gone

    packed = stages["packing"](spark, kept, folder)
    times = Counter(i for i, _ in exact)
    totals = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d")).collect()
    assert all(r["n"] == times[r["doc_id"]] * r["d"] for r in totals)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in exact}


def test_filtering_stages_are_their_operators(spark, folder):
    from agromix.llm.rules import quality_rules
    from agromix.llm.toxicity import fit_toxicity, score_toxicity

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + (i or 0), t, "en", "s", 0) for i, t in planted()[-12:]], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd.select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns)))
    labels, stages = spark.read.parquet(f"{folder}/labels.parquet"), dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    assert ids(stages["toxicity"](spark, docs, folder)) == ids(scored.filter("predicted = 0"))
    assert ids(stages["quality_rules"](spark, docs, folder)) == ids(quality_rules(docs, labels).filter("kept"))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.withColumns({"kept": F.lit("k"), "score": F.lit(1), "n_words": F.lit("n"), "class_id": F.lit(None).cast("string"), "row": F.lit(2)})
    last = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, last, folder))
        assert out.columns == wide.columns, name
        assert out.exceptAll(last).isEmpty() and 0 < out.count() <= last.count()
        assert out.filter("kept <> 'k' or score <> 1 or n_words <> 'n'").isEmpty()
        last = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, last, folder)
    assert pieces.select("doc_id").distinct().count() == last.select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, folder)
    assert whole.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d")).filter("n <> d").isEmpty()


def test_stage_on_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).isEmpty()
