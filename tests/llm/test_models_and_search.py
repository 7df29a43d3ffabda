"""Classifiers on held-out rows, searches against brute force, archives through damage."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import multiprobe_lsh, pu_quality, queries, subsequence_svm, taat_topk, warc_salvage

SF = "/root/testdata/sf0.01"
SF_LARGE = "/root/testdata/sf0.1"


def test_kernel_equals_its_definition():
    p = subsequence_svm.Params(decay=0.5, max_span=5)
    from itertools import combinations

    def phi(w):
        found = {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < 5:
                found.setdefault(w[i] + w[j] + w[k], []).append(0.5 ** (k - i + 1))
        norm = np.sqrt(sum(x * x for v in found.values() for x in v))
        return {u: sum(v) / norm for u, v in found.items()}

    words = ["^stupid$", "^stxupid$", "^aaaa$", "^no$"]
    want = [[sum(x * phi(b).get(u, 0) for u, x in phi(a).items()) for b in words] for a in words]
    assert np.allclose(subsequence_svm.kernel(words, words, p), want, atol=1e-5)


def test_gapped_and_spaced_insults():
    """Words never seen in training, with gaps and inserted characters, fall on the side of the word they hide."""
    clean = [f"^{a}{b}{c}$" for a in ("the", "and", "ran", "sto", "pid", "stu") for b in ("ing", "er", "lo", "mi", "") for c in ("ed", "ly", "ton", "ra", "")]
    toxic = ["^stupid$", "^moron$", "^idiot$", "^worthless$"]
    p = subsequence_svm.Params()
    table, bias = subsequence_svm.train_words(toxic, np.array([50.0] * 4), clean, clean[:20], p)
    model = subsequence_svm.Model(p, 0.1, table, bias, np.array([4.0, 0, 0, 0, 0]))
    s = subsequence_svm.Scorer(model)
    high = s.scores(["you s.t.u.p.i.d one", "you s t u p i d one", "a sttupid thing", "wor-thless", "m o r o n"])
    low = s.scores(["the anding", "", None, "ran stoton pided", "a b c"])
    assert high.min() > low.max()


def test_witnesses_of_sentences(spark):
    """Every clean sentence, and the sentences of a toxic document that look toxic, enter by their largest window."""
    p = subsequence_svm.Params()
    clean = [f"^{a}{b}$" for a in ("the", "and", "ran", "sto", "pid") for b in ("ing", "er", "lo", "mi", "ton")]
    table, bias = subsequence_svm.train_words(["^stupid$", "^moron$"], np.array([5.0, 5.0]), clean, [], p)
    texts = [("Anding thelo. You m o r o n here!\nRaning stupid, s-t-u-p-i-d pider. Anding.", 1), ("thelo ander. Raning", 1), ("Thelo raner. Pidmi? andlo", 0), ("Thelo raner.", 0), ("", 0), (" . ", 1)]
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, y int")
    model = subsequence_svm.Model(p, 0.5, table, bias)
    decide = lambda w: float(subsequence_svm.decide_words(table, [w], p)[0] + np.float32(bias))
    want = {}
    for text, y in texts:
        best = [max(bag, key=lambda w: (decide(w), w)) for bag in subsequence_svm.sentences(text)]
        if y and best:
            best = {w for w in best if decide(w) > 0} or {max(best, key=lambda w: (decide(w), w))}
        for w in best:
            want[w, y] = want.get((w, y), 0) + 1
    for keep in (0, 1000):
        got = subsequence_svm.witnesses(spark, rows, model, keep).collect()
        assert {(r["word"], r["y"]): r["n"] for r in got} == want
        assert all(abs(r["d"] - decide(r["word"])) < 1e-5 for r in got)
    assert ("^moron$", 1) in want and ("^stupid$", 1) in want


def test_toxicity_held_out_at_scale(spark):
    """Insults of every language are learnt where each has some dozens of toxic documents."""
    labels = spark.read.parquet(f"{SF_LARGE}/labels.parquet")
    got = queries.op1_toxicity(spark, SF_LARGE).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in got}
    assert share[1] >= 0.9 and share[0] <= 0.01


def test_toxicity_held_out(spark, documents, nothing):
    out = queries.op1_toxicity(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = [(r["held_out"], r["toxic"], r["predicted"]) for r in out.join(labels, "doc_id").collect()]
    held = [(t, p) for h, t, p in got if h]
    assert sum(p for t, p in held if t == 0) <= 1 and sum(p for t, p in held if t) >= 0.6 * sum(t for t, _ in held)
    assert out.where("score < 0 or score > 1 or score is null").isEmpty() and out.count() == 1000
    model = subsequence_svm.fit(spark, documents.select("doc_id", "text"), labels.limit(0), F.lit(True))
    assert model.table is None and {r["score"] for r in subsequence_svm.score(spark, documents, model).collect()} == {0.0}
    assert subsequence_svm.score(spark, nothing, model).count() == 0
    kept = subsequence_svm.keep_clean(spark, documents, model)
    assert kept.columns == documents.columns and kept.count() == documents.count()


def test_quality_held_out(spark, documents, nothing):
    out = queries.op5_quality(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = [(r["quality"], r["predicted"]) for r in out.join(labels, "doc_id").where("held_out").collect()]
    assert sum(p for q, p in held if q) >= 0.98 * sum(q for q, _ in held) and sum(1 - p for q, p in held if not q) >= 0.5 * sum(1 - q for q, _ in held)
    model = pu_quality.fit(spark, documents.select("doc_id", "text"), labels.limit(0), F.lit(True))
    assert {r["score"] for r in pu_quality.score(spark, documents, model).collect()} == {0.0}
    assert pu_quality.score(spark, nothing, model).count() == 0


def test_trained_models_on_null_empty_and_long_texts(spark):
    """The trained network and the trained kernel machine score every row alike, whatever stands around it."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = [(None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "x" * 200_000), (5, "word " * 60_000), (5, "word " * 60_000), (6, "\ud83d\ude00 \u0000 é"), (None, "a null id")]
    rows = spark.createDataFrame([(i, t, 0.5, "clash") for i, t in odd], "doc_id long, text string, score double, fp string")
    quality = pu_quality.score(spark, rows, pu_quality.fit(spark, docs, labels, F.lit(True)))
    toxic = subsequence_svm.fit(spark, docs, labels, F.lit(True))
    assert toxic.table is not None
    scored = subsequence_svm.score(spark, rows, toxic)
    for out in (quality, scored):
        got = [(r["doc_id"], r["score"]) for r in out.collect()]
        assert len(got) == len(odd) and all(0 <= s <= 1 for _, s in got)
        assert len({s for i, s in got if i == 5}) == 1 and len({s for i, s in got if i in (1, 2)}) == 1
    assert subsequence_svm.keep_clean(spark, rows, toxic).count() == scored.where("score < 0.7").count()


def test_models_learn_one_text_of_an_id(spark):
    """Ids that repeat, with the same text or a larger one, change nothing."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").where("text is not null")
    twice = docs.union(docs).union(docs.withColumn("text", F.concat("text", F.lit(" zzz"))))
    probe = docs.where("doc_id < 50")
    once_q, more_q = (pu_quality.fit(spark, d, labels, F.lit(True), pu_quality.Params(epochs=1)) for d in (docs, twice))
    assert np.allclose(once_q.mean, more_q.mean) and once_q.prior == more_q.prior
    small = subsequence_svm.Params(landmarks=64, max_words=600, rounds=1)
    once, more = (subsequence_svm.fit(spark, d, labels, F.lit(True), p=small) for d in (docs, twice))
    a, b = ({r["doc_id"]: r["score"] for r in subsequence_svm.score(spark, probe, m).collect()} for m in (once, more))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-4


def test_positive_unlabelled_risk():
    """Two clouds: the prior is found, and the risk separates them without a negative label."""
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(2, 1, (3000, 4)), rng.normal(-2, 1, (1200, 4))
    unlabelled = np.r_[rng.normal(2, 1, (1800, 4)), negative]
    p = pu_quality.Params(epochs=20)
    prior = pu_quality.estimate_prior(positive, unlabelled, p)
    assert abs(prior - 0.6) < 0.06
    net = pu_quality.train(positive, unlabelled, prior, p)
    z = pu_quality._forward(net, unlabelled)[0]
    assert (z[:1800] > 0).mean() > 0.97 and (z[1800:] < 0).mean() > 0.97


def vectors(spark, n=900, dim=16, extra=()):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    rows += [(n, None), (n + 20, [0.0] * dim), (n + 40, [float("nan")] * dim), (n + 60, [None] + [1.0] * (dim - 1)), (n + 80, [float("inf")] * dim), (None, [1.0] * dim), *extra]
    return rows, spark.createDataFrame([(*r, 3.0, "x") for r in rows], "vec_id long, embedding array<float>, score double, tab string")


def usable(rows, zero=True):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and (zero or any(v))]


@pytest.mark.parametrize("rows_per_block", [64, 4096])
def test_exact_topk(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(taat_topk, "ROWS", rows_per_block)
    rows, df = vectors(spark, 300, extra=[(600, [0.5] * 16), (601, [0.5] * 16), (602, [0.5] * 16), (620, [0.25] * 16)])
    got = taat_topk.top_k(spark, df, F.col("vec_id") % 20 == 0, 20).collect()
    good = [(i, np.floor(64 * v).astype(int)) for i, v in usable(rows)]
    want = []
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-int(a @ b), i) for i, b in good if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)
    few = df.where("vec_id in (0, 5, 20)")
    assert taat_topk.top_k(spark, few, F.col("vec_id") % 20 == 0, 20).count() == 4
    assert taat_topk.top_k(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_of_large_integers():
    q, r = np.array([[1 << 29, -3, 0]]), np.array([[1 << 29, 5, 1], [0, 0, 0], [-(1 << 29), 2, 9]])
    assert (taat_topk.scatter_scores(q, r) == q @ r.T).all()


def test_multiprobe(spark):
    same = [(2000 + i, [1.0] * 16) for i in range(40)]
    rows, df = vectors(spark, 1500, extra=same + [(3000, [1.0] * 8), (3100, [2.0] * 8)])
    got = multiprobe_lsh.search(spark, df, F.col("vec_id") % 100 == 0, 10).collect()
    good = usable(rows, zero=False)
    hit = total = 0
    for q, a in good:
        if q % 100:
            continue
        near = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in good if i != q and len(b) == len(a))[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [k for k, _, _ in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(near)
        assert all(abs(s - np.sqrt(((a - dict(good)[i]) ** 2).sum())) < 1e-9 for _, i, s in mine)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & {i for _, i in near})
        total += len(near)
    assert hit / total >= 0.9
    assert multiprobe_lsh.search(spark, df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert multiprobe_lsh.search(spark, df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).count() == 2


def test_multiprobe_skips_most_rows_where_there_is_structure(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(800, 32)), 25, 0) + rng.normal(0, 0.1, (20_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = multiprobe_lsh.search(spark, df, F.col("vec_id") % 500 == 0, 10).collect()
    found, visited = {}, {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        visited[r["query_id"]] = r["visited"]
    near = {q: set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11].tolist()) for q in range(0, 20_000, 500)}
    assert np.mean([len(near[q] & found[q]) / 10 for q in near]) >= 0.9 and np.mean(list(visited.values())) < 0.1 * len(x)


def test_searches_of_repeated_and_null_ids(spark):
    """Every query row is answered, every other row is a candidate, and rows of the query's own id are none."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [0.9, 0.0]), (3, [0.0, 0.9]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multiprobe_lsh.search(spark, df, F.col("vec_id") == 0, 10).collect()
    assert sorted((r["query_id"], r["vec_id"], round(r["score"], 6)) for r in got) == sorted((0, i, round(math.dist(q, v), 6)) for _, q in rows[:2] for i, v in rows[2:5])
    got = taat_topk.top_k(spark, df, F.col("vec_id") == 0, 10).collect()
    cut = lambda v: [math.floor(64 * x) for x in v]
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == sorted((0, i, sum(a * b for a, b in zip(cut(q), cut(v)))) for _, q in rows[:2] for i, v in rows[2:5])


def test_probe_order_follows_the_chance():
    h = multiprobe_lsh.Hashing(1, 3, 1.0, 0.9, 1.0, 1.0, np.zeros(8), 0)
    at = np.array([0.1, 0.5, 5.97])
    cells = multiprobe_lsh.probe_cells(at, h)
    rng = np.random.default_rng(1)
    drawn = np.floor(at + rng.normal(size=(200_000, 3))).astype(int)
    share = [(drawn == c).all(1).mean() for c in cells]
    assert share[0] == max(share) and sum(share) == pytest.approx(0.9, abs=0.02) and np.corrcoef(range(len(share)), share)[0, 1] < -0.5


def pages(spark):
    big = "<html>" + "gleich " * 300
    rows = [(1, "http://a", big), (9, "http://b", big), (5, None, big), (2, "u v", "short"), (3, "w", "short"), (4, "x", None), (7, "y", ""), (8, "z", "é" * 600), (None, "n", big), (11, "q", "\r\n\r\nWARC/1.1 \x1f body"), (9, "http://b", big)]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, n int")


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    got = warc_salvage.round_trip(spark, df)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html is not None and len(data) >= 1000 and html.startswith("<html>") and i != 9
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert warc_salvage.round_trip(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    r = random.Random(3)
    bodies = [bytes(r.randrange(256) for _ in range(r.randrange(20, 900))) for _ in range(8)]
    raw = [warc_salvage.record(i, "http://x", b, None, "response") for i, b in enumerate(bodies)]
    parts = [warc_salvage.member(x) if packed else x for x in raw]
    whole = b"".join(parts)
    records, gaps = warc_salvage.salvage(whole)
    assert [x.payload for x in records] == bodies and gaps == []
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    broken = bytearray(whole)
    broken[starts[2] + len(parts[2]) // 2] ^= 0xFF  # one record is damaged
    at = starts[5] + 7  # garbage goes in, a record loses its end
    broken = bytes(broken[:at]) + b"\x1f\x8b\x08 no member, WARC/1.1 no record " + bytes(broken[at:-5])
    records, gaps = warc_salvage.salvage(broken)
    kept = [warc_salvage.page_of(x.headers["warc-record-id"]) for x in records]
    whole_kept = [0, 1, 3, 4, 6]
    assert kept == whole_kept + [7] * packed and all(x.payload == bodies[k] for x, k in zip(records, kept))  # the last member lacks its checksum only
    assert [(a, b) for a, b, _ in gaps][0] == (starts[2], starts[3]) and gaps[-1][1] == len(broken)
    covered = sum(b - a for a, b, _ in gaps)
    assert covered == len(broken) - sum(len(parts[k]) for k in whole_kept)
    assert warc_salvage.salvage(b"") == ([], []) and warc_salvage.salvage(b"junk")[1][0][:2] == (0, 4)
    if packed:
        assert gzip.decompress(whole) == b"".join(raw)


def test_salvage_of_hostile_headers():
    """Numbers, ids and digests that cannot be read, and a payload that is not the stated one, are damage; the rest stands."""
    good = warc_salvage.record(1, "http://x", b"body", None, "response")
    swap = [(b"Content-Length: ", "Content-Length: ²".encode()), (b"Content-Length: ", b"Content-Length: -"), (b"sha1:", b"sha1:!"), (b"<urn:x-page:1>", b"<urn:x-page:--5>"), (b"<urn:x-page:1>", b"<urn:x-page:99999999999999999999>")]
    for old, new in swap:
        records, gaps = warc_salvage.salvage(good.replace(old, new, 1) + good)
        assert records[-1].payload == b"body" and len(records) + len(gaps) == 2
        assert all(warc_salvage.page_of(r.headers["warc-record-id"]) in (1, None) for r in records)
    other = warc_salvage.record(2, "http://x", b"other", None, "response")
    stated = next(x for x in other.split(b"\r\n") if x.startswith(b"WARC-Payload-Digest"))
    mine = next(x for x in good.split(b"\r\n") if x.startswith(b"WARC-Payload-Digest"))
    records, gaps = warc_salvage.salvage(good.replace(mine, stated) + other)
    assert [warc_salvage.page_of(r.headers["warc-record-id"]) for r in records] == [2] and gaps[0][2] == "payload digest differs"
    several = warc_salvage.member(good + b"WARC/1.1\r\nno header\r\n\r\n" + other)
    records, gaps = warc_salvage.salvage(several)
    assert [r.payload for r in records] == [b"body", b"other"] and len(gaps) == 1


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.lists(st.tuples(st.integers(0, 2000), st.binary(max_size=6)), max_size=6), st.booleans())
def test_salvage_takes_any_bytes(noise, changes, packed):
    raw = [warc_salvage.record(i, "http://x", b"%d payload " % i * 9, None, "response") for i in range(3)]
    data = bytearray(noise + b"".join(warc_salvage.member(x) if packed else x for x in raw))
    for at, new in changes:
        data[at : at + len(new)] = new
    records, gaps = warc_salvage.salvage(bytes(data))
    assert all(0 <= a < b <= len(data) for a, b, _ in gaps) and [g[0] for g in gaps] == sorted(g[0] for g in gaps)
    assert len(records) == 3 or changes


def test_archives_of_long_payloads_in_several_files(spark, tmp_path):
    rows = [(i, "http://x", ("word%d " % i) * 40_000) for i in range(6)] + [(9, None, "same " * 50_000), (8, None, "same " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    where = f"file://{tmp_path}/a"
    assert warc_salvage.write_archives(spark, df, where, file_bytes=2000) == 8
    got = warc_salvage.read_archives(spark, where).collect()
    assert {(r["page_id"], r["html"]) for r in got if r["record_type"] == "response"} == {(i, h) for i, _, h in rows if i != 8}
    assert [(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"] == [(8, 9)] and len({r["file"] for r in got}) > 2
