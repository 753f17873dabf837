"""The corpus pipeline, stage by stage against brute force on what the stage before kept."""

from __future__ import annotations

import random
from collections import Counter

from tests.llm import brute

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(f"{rng.choice('abcdef')}{rng.randrange(900)}" for _ in range(rng.randrange(6, 120)))) for i in range(80)]
    for i in range(80, 100):
        w = rows[i - 80][1].split()
        if len(w) > 60:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "12 34 !"), (103, rows[5][1]), (104, rows[5][1].upper())]
    sources = {i: rng.choice(["a", "b", None]) for i, _ in rows}
    spark.createDataFrame([(i, t, "en", sources[i], 0, "x") for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, held = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        found = docs.collect()
        if name == "pack":
            tokens = Counter()
            for r in found:
                tokens[r.sequence_id] += r.length
            assert max(tokens.values()) <= 1024 and {r.doc_id for r in found} == {i for i, _ in held}
            assert sum(r.start == 0 for r in found) == len(held)
            continue
        assert docs.columns == columns
        if name == "language":
            want = {i for i, t in held if t and any(c.isalpha() for c in t)}
        elif name == "exact":
            want = {i for i, (_, _, kept, _) in brute.exact(held).items() if kept}
        elif name == "near":
            want = {i for i, (_, _, kept) in brute.near(held, 80).items() if kept}
        else:
            copies = Counter(r.doc_id for r in found)
            assert set(copies) <= {i for i, _ in held} and max(copies.values()) <= 3
            size = {i: len(brute.words(t)) for i, t in held}
            total = Counter()
            for i in size:
                total[sources[i]] += size[i]
            for s, share in zip(["a", "b", None], (5, 2, 1)):
                taken = sum(size[i] * n for i, n in copies.items() if sources[i] == s)
                assert abs(taken - sum(total.values()) * share / 8) <= max(5, 0.02 * taken)
            held = [(r.doc_id, r.text) for r in found]
            continue
        assert sorted(r.doc_id for r in found) == sorted(want), name
        held = [(i, t) for i, t in held if i in want]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_are_judged_one_by_one(spark):
    """Rows that share a doc_id, or have none, and columns named as the stages' own."""
    rng = random.Random(12)
    text = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(900)}" for _ in range(90)) for _ in range(12)]
    near = text[0].split()
    near[40] = "changed"
    rows = [(i % 4 if i % 5 else None, t) for i, t in enumerate(text)] + [(1, text[3]), (1, text[3]), (7, " ".join(near)), (8, "b c")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, _row string, _row_ long, _id long"
    docs = spark.createDataFrame([(i, t, "en", "ab"[k % 2], 0, "x", 1, 2) for k, (i, t) in enumerate(rows)], kind).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact"](spark, docs, "")
    assert exact.columns == docs.columns and sorted(r.text for r in exact.collect()) == sorted({t for _, t in rows})
    kept = [r.text for r in stages["near"](spark, exact, "").collect()]
    assert len(kept) == len({t for _, t in rows}) - 1 and len({text[0], " ".join(near)} & {*kept}) == 1
    mixed = Counter(r.text for r in stages["mix"](spark, docs, "").collect())
    copies = Counter(t for _, t in rows)
    assert set(mixed) <= set(copies) and all(n <= 3 * copies[t] for t, n in mixed.items())
    size = sum(len(t.split()) * n for t, n in mixed.items())
    assert abs(size - sum(len(t.split()) for _, t in rows)) <= 90
