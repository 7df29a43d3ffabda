"""The pipeline: each stage keeps the columns, and does what its operator does."""

from collections import Counter, defaultdict

from test_text_ops import BLANK, brute_fingerprint, brute_lines, brute_targets, classes, tokenized

import corpus_pipeline
from quarry.llm import line_edit_join, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    for docs in (documents, documents.limit(0), documents.select("doc_id", "text", "source")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in queries.op1_toxicity(spark, SF).collect()}
    clean = corpus_pipeline.toxicity(spark, docs, SF)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, p in scored.items() if p == 0}
    lined = corpus_pipeline.line_dedup(spark, clean, SF)
    assert lined.where("n_chars <> length(text)").isEmpty() and lined.count() == clean.count()
    assert line_edit_join.dedup(spark, lined).where("__lines <> __kept").isEmpty()  # nothing is left to drop
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty() and packed.count() > 0


def test_stages_equal_brute_force(spark, documents):
    """Each stage after the classifier, on what the one before kept, against a plain version over all rows."""
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    docs = documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    lined = corpus_pipeline.line_dedup(spark, docs, SF)
    assert sorted(pairs(lined), key=repr) == sorted(brute_lines(pairs(docs)), key=repr)

    single = corpus_pipeline.near_duplicates(spark, lined, SF)
    fps = {i: brute_fingerprint(t) for i, t in pairs(lined)}
    label = classes(set(fps.values()), [(a, b) for a in fps.values() for b in fps.values() if a < b and (a ^ b).bit_count() <= 2])
    first = {}
    for i in sorted(fps):
        first.setdefault(label[fps[i]], i)
    assert sorted(i for i, _ in pairs(single)) == sorted(first.values())

    mixed = corpus_pipeline.mixing(spark, single, SF)
    sizes, largest, source = defaultdict(int), defaultdict(int), {}
    for r in single.collect():
        n = len(BLANK.findall(r["text"] or ""))
        source[r["doc_id"]] = (r["source"], n)
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    copies, taken = Counter(i for i, _ in pairs(mixed)), defaultdict(int)
    for i, c in copies.items():
        taken[source[i][0]] += c * source[i][1]
    assert max(copies.values()) <= 3
    for s, target in brute_targets(dict(sizes)).items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-6

    packed, rows = corpus_pipeline.packing(spark, mixed, SF).collect(), pairs(mixed)
    want = Counter()
    for (i, _), ids in zip(rows, tokenized("word_bpe_49k.json", [t for _, t in rows])):
        want.update((i, k, lo, min(2048, len(ids) - lo)) for k, lo in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        ends = [o + n for o, n in sorted(pieces)]
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_empty_and_null_rows_pass_every_stage(spark):
    """Nulls in every column, and no text at all, neither crash a stage nor lose a different text."""
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (3, "a text of its own, alone here", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.line_dedup(spark, docs, SF)
    assert clean.count() == 3
    kept = corpus_pipeline.near_duplicates(spark, clean, SF)
    assert sorted((r["text"] or "") for r in kept.collect()) == ["", "a text of its own, alone here"]
