"""Near-duplicates, lines, mixing, token files, packing against brute force and round trips."""

import math
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bound_packing, huffman_ids, line_edit_join, runtime, simhash_bk, source_mixing, token_ids
from quarry.llm.runtime import Workspace, connected_components
from quarry.llm.token_ids import Encoder, tokenizer_file

BLANK = re.compile("[^\x20\x09-\x0D]+")


def classes(items, linked):
    """Items joined by links, by repeated relabelling."""
    label = {x: x for x in items}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], changed = low, True
    return label


def brute_fingerprint(text):
    words = BLANK.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, documents, nothing):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    fps = {brute_fingerprint(t) for _, t in rows}
    comp = classes(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    first = defaultdict(list)
    for i, t in rows:
        if i is not None:
            first[comp[brute_fingerprint(t)]].append(i)
    want = sorted(((i, f"{brute_fingerprint(t):016x}", min(first[comp[brute_fingerprint(t)]], default=None)) for i, t in rows), key=repr)
    got = simhash_bk.components(spark, documents)
    assert sorted(map(tuple, got.collect()), key=repr) == want and got.columns == ["doc_id", "fingerprint", "component_id"]
    kept = simhash_bk.keep_first(spark, documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in want if c is not None})
    assert ids.count(None) == (1 if any(c is None for _, _, c in want) else 0)
    assert simhash_bk.components(spark, nothing).count() == 0 and simhash_bk.keep_first(spark, nothing).count() == 0


def test_keep_first_of_null_and_shared_ids(spark):
    """Ids that are null or shared by different texts lose no text; copies still go, whatever their ids."""
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    rows = [(None, text(n), None, "s") for n in range(5)] + [(None, text(0), None, "s"), (None, text(1), "en", None)]
    rows += [(7, text(5), "en", "s"), (7, text(6), "en", "s"), (7, text(6), "en", "s"), (8, text(6), None, None), (None, text(6), "en", "s")]
    rows += [(9, text(7), "en", "s"), (9, text(8), "en", "s"), (3, text(8), "en", "s"), (9, None, "en", "s"), (None, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = simhash_bk.keep_first(spark, docs)
    want = [(None, text(n)) for n in range(5)] + [(7, text(5)), (7, text(6)), (9, text(7)), (3, text(8)), (9, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr) and got.columns == docs.columns



def test_large_shards_and_common_fingerprints(spark, monkeypatch):
    """Shards cut into several trees lose no link, and fingerprints of many rows are joined apart."""
    monkeypatch.setattr(simhash_bk, "SPLIT", 8)
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(0, 1 << 62, 3)]
    fps = sorted({b ^ sum(1 << int(i) for i in r.choice(64, int(r.integers(0, 5)), replace=False)) for b in base for _ in range(120)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in fps]
    got = simhash_bk.links(Workspace(spark, "t"), spark.createDataFrame(signed, "fp long"), 2).collect()
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    pairs = [tuple(sorted((x["a"] & (1 << 64) - 1, x["b"] & (1 << 64) - 1))) for x in got]
    assert set(pairs) == want and len(pairs) == len(want)
    monkeypatch.setattr(simhash_bk, "HOT", 2)
    rows = [(i, ("a b c", "d e f", f"some other words {i}")[min(i % 4, 2)]) for i in range(24)]
    out = simhash_bk.components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert sorted((x["doc_id"], x["component_id"]) for x in out) == sorted((i, first[t]) for i, t in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), unique=True, max_size=30), st.integers(0, 6))
def test_bk_tree_finds_all_within_the_radius(values, radius):
    near = values + [v ^ 1 << (v % 64) for v in values]
    tree, seen = simhash_bk.BKTree(), []
    for v in dict.fromkeys(near):
        assert sorted(tree.near_then_add(v, radius)) == sorted(x for x in seen if (x ^ v).bit_count() <= radius)
        seen.append(v)


@pytest.mark.parametrize("hub", [1 << 16, 8])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(runtime, "HUB", hub)
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)] + [(200, 200 + i) for i in range(1, 60)]
    got = connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    want = classes({x for e in edges for x in e}, edges)
    assert {(r["node"], r["component"]) for r in got.collect()} == {(k, v) for k, v in want.items()}
    assert connected_components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", max_size=22), st.lists(st.tuples(st.sampled_from("ids"), st.integers(0, 30), st.sampled_from("abcé")), max_size=5), st.integers(0, 4))
def test_edit_distance_and_segments(a, edits, k):
    b = list(a)
    for kind, at, c in edits:
        at = min(at, len(b))
        if kind == "i":
            b.insert(at, c)
        elif at < len(b):
            b[at : at + 1] = [] if kind == "d" else [c]
    b = "".join(b)
    assert line_edit_join.within(a, b, k) == (distance(a, b) <= k)
    if a and b and a != b and k and line_edit_join.near(a, b, k):
        ka, kb = line_edit_join.keys_of(a, k), line_edit_join.keys_of(b, k)
        index = lambda ks: {x for x, kind, _, _ in ks if kind == 0}
        every = lambda ks: {x for x, *_ in ks}
        assert index(ka) & every(kb) or index(kb) & every(ka)


def brute_lines(rows):
    """The texts without repeated lines."""
    occurrences = [((i is None, i, p, t), line) for i, t in dict.fromkeys(rows) for p, line in enumerate((t or "").split("\n")) if line.strip()]
    lines = sorted({line for _, line in occurrences})
    linked = [(a, b) for a in lines for b in lines if a < b and abs(len(a) - len(b)) <= 2 and line_edit_join.near(a, b, 2)]
    label = classes(lines, linked)
    keep = {}
    for place, line in sorted(occurrences, key=lambda x: (x[0][0], x[0][1] or 0, x[0][2])):
        keep.setdefault(label[line], place)
    gone = {place for place, line in occurrences if keep[label[line]] != place}
    return [(i, t if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if (i is None, i, p, t) not in gone)) for i, t in rows]


def test_line_dedup(spark, documents, nothing):
    some = documents.where("doc_id is not null")  # nulls tie: which of them is first is not defined
    rows = [(r["doc_id"], r["text"]) for r in some.select("doc_id", "text").collect()]
    out = line_edit_join.dedup(spark, some)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(brute_lines(rows), key=repr)
    assert out.drop("__lines", "__kept").columns == documents.columns
    assert line_edit_join.dedup(spark, documents).count() == documents.count() and line_edit_join.dedup(spark, nothing).count() == 0


def test_line_dedup_splits_hot_keys(spark, monkeypatch):
    """Many lines that share a segment, most of them not near: keys are split and no link is lost."""
    monkeypatch.setattr(line_edit_join, "SPLIT", 6)
    stem = "the quick brown fox jumps over the lazy dog "
    tails = [f"{i:04d}{i * 7919 % 10007:05d}{i * 104729 % 99991:05d}" for i in range(60)]
    rows = [(i, stem + t) for i, t in enumerate(tails)] + [(100 + i, stem + t[:-1] + "z") for i, t in enumerate(tails[:20])]
    out = line_edit_join.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(brute_lines(rows))


def test_line_keys_are_handed_on_while_a_batch_is_read(monkeypatch):
    """One batch of long texts: no more than some 131,072 keys are held at once, and lines met after a full memory change nothing."""

    class Documents:
        select, runs = (lambda self, *columns: self), []

        def mapInArrow(self, run, schema):
            self.runs.append(run)
            raise StopIteration

        sparkSession = property(lambda self: self)
        conf = property(lambda self: {"spark.sql.shuffle.partitions": "4"})

    documents = Documents()
    with pytest.raises(StopIteration):
        line_edit_join.shared_keys(documents, 2)
    texts = ["\n".join(f"line {i} of text {j} with some words" for i in range(400)) for j in range(60)] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    want = {(line_edit_join._signed(k), line_edit_join.line_id(x) | kind) for t in texts[:60] for x in t.split("\n") for k, kind, _, _ in line_edit_join.keys_of(x, 2)}
    for seen in (1 << 20, 1000):
        monkeypatch.setattr(line_edit_join, "_SEEN", seen, raising=False)
        calls = []
        with monkeypatch.context() as m:
            keys_of = line_edit_join.keys_of
            m.setattr(line_edit_join, "keys_of", lambda *a: calls.append(1) or keys_of(*a))
            most, before, got = 0, 0, set()
            for b in documents.runs[0]([batch]):
                most, before = max(most, len(calls) - before), len(calls)
                got |= set(zip(b.column("key").to_pylist(), b.column("id").to_pylist()))
        assert got == want and most < 20_000 and (len(calls) == 24_000) == (seen > 1000)


def test_line_dedup_without_broadcasts(spark, monkeypatch):
    """Beyond the size at which tables are broadcast: the same rows."""
    monkeypatch.setattr(line_edit_join, "small_enough", lambda *a, **k: False)
    lines = ["the first line of all", "the first line of al", "a second line, here", "quite another line", "a second line, there", "last of them all"]
    rows = [(i, "\n".join(lines[j % 6] for j in range(i, i + 4))) for i in range(12)]
    out = line_edit_join.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(brute_lines(rows))


def test_line_dedup_of_numbered_lines(spark, monkeypatch):
    """Near lines that all share their keys, and strangers among them: no link is lost and no key grows from round to round."""
    monkeypatch.setattr(line_edit_join, "SPLIT", 16)
    rows = [(i, f"This is page {i:03d}") for i in range(0, 300, 2)] + [(400 + i, f"This is page {'abcdefghijklm'[i]}{'nopqrstuvwxyz'[i]}{i % 7}{'zyxwvu'[i % 6]}") for i in range(13)]
    rows += [(500, "Page 1"), (501, "Page 22"), (502, "Page 333"), (503, "This is quite another page")]
    sizes = []
    table = Workspace.table

    def watched(self, df, name):
        out = table(self, df, name)
        if name in ("members", "finer"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "table", watched)
    out = line_edit_join.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(brute_lines(rows))
    assert max(sizes) <= 2 * sizes[0]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(3 * sizes[s] for s in capped), [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_mixing(spark, documents, nothing):
    out = source_mixing.mix(spark, documents).collect()
    sizes = defaultdict(int)
    for r in documents.collect():
        sizes[r["source"]] += len(BLANK.findall(r["text"] or ""))
    want = brute_targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(out) == documents.count()
    for s, target in want.items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-6
    pick = lambda rows: sorted(((r["doc_id"], r["size"], r["taken"]) for r in rows), key=repr)
    assert pick(source_mixing.mix(spark, documents.repartition(5)).collect()) == pick(out)
    again = source_mixing.repeat_documents(spark, documents)
    assert again.columns == documents.columns and again.count() == sum(r["copies"] for r in out)
    assert source_mixing.mix(spark, nothing).count() == 0 and source_mixing.repeat_documents(spark, nothing).count() == 0


def test_targets_of_an_uneven_pair(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a") for i in range(9)] + [(99, "w " * 10, "b")], "doc_id long, text string, source string")
    got = {r["source"]: (r["target"], r["taken"]) for r in source_mixing.mix(spark, df).groupBy("source").agg({"target": "max", "taken": "sum"}).withColumnsRenamed({"max(target)": "target", "sum(taken)": "taken"}).collect()}
    assert got["b"] == (30.0, 30) and got["a"] == (70.0, 70)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_texts(name):
    e = Encoder(tokenizer_file(name))
    assert e.cut

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.text(st.sampled_from(list("abé.,!'1_\n\t  　İßǺ\r😀<|>")), max_size=30), max_size=4))
    def same(texts):
        assert e.encode_all(texts) == [e.whole(t).tobytes() for t in texts]

    same()
    assert e.encode_all([None, "", "<|endoftext|> a<|endoftext|>"])[:2] == [b"", b""]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_that_forgets_equals_whole_texts(name):
    """Stretches that do not stand alone come again in the very call that makes the encoder forget."""
    e = Encoder(tokenizer_file(name), keep=6)
    odd = ["left tab\there and there", "one line\r\nand another", "a no-break\u00a0blank", "ends \nwith blanks", "wide\u3000blank stands"]
    for i in range(6):
        texts = [*odd, f"plain words {i}", *(f"longer{i}word{j} unheard{i}of{j}" for j in range(8)), "x y"]
        assert e.encode_all(texts) == [e.whole(t).tobytes() for t in texts]
        assert all(e._join(t).tolist() == e.whole(t).tolist() for t in [*odd, f"again{i} other{i}words \tand tab\there"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=60), st.integers(9, 16))
def test_huffman_codes_are_limited_optimal_and_decodable(counts, limit):
    counts = np.array(counts)
    lengths = huffman_ids.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(int)
    assert ((lengths > 0) == (counts > 0)).all() and (len(used) == 0 or used.max() <= max(limit, 6))
    if len(used) > 1:
        assert sum(2.0**-n for n in used) == 1
        import heapq

        heap, cost = [int(c) for c in counts[counts > 0]], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        plain = int((counts * lengths.astype(int)).sum())
        assert plain >= cost and (limit < 16 or plain == cost)
    ids = np.repeat(np.arange(len(counts)), counts).astype(np.uint32)
    np.random.default_rng(1).shuffle(ids)
    cut = len(ids) // 3
    low = -(1 << 63)
    data = huffman_ids.encode_file([(None, ids[:cut]), (low, ids[cut:cut]), (7, ids[cut:])], lengths, huffman_ids.canonical(lengths)[1])
    back = list(huffman_ids.decode_file(data))
    assert [k for k, _ in back] == [None, low, 7] and all((a == b).all() for (_, a), b in zip(back, (ids[:cut], ids[cut:cut], ids[cut:])))


def tokenized(name, rows):
    t = Tokenizer.from_file(tokenizer_file(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in rows]


def test_token_files(spark, documents, nothing, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    ids = tokenized("byte_bpe_50k.json", [t for _, t in rows])
    crc = [zlib.crc32(np.array(x, "<u2").tobytes()) for x in ids]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, crc[i]))
    want, at = [], 0
    for i in order:
        want.append((rows[i][0], at, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        at += len(ids[i])
    for file_ids in (1 << 21, 4000):
        ws = Workspace(spark, "t")
        where = ws.path("files")
        huffman_ids.write_files(spark, documents, where, ws, "byte_bpe_50k.json", file_ids=file_ids)
        rowsets = huffman_ids.read_files(spark, where).orderBy("file", "at").collect()
        assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rowsets] == [(i, n, c) for i, _, n, c in want]
        assert (len({r["file"] for r in rowsets}) > 3) == (file_ids == 4000)
    got = huffman_ids.round_trip(spark, documents)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert huffman_ids.round_trip(spark, nothing).count() == 0


def test_tokenizing_remembers_little(spark, tmp_path, monkeypatch):
    """Over 2,100,000 different words among common ones, what a worker remembers for token files stays below 200 MB."""

    class Documents:
        select, mapInArrow = (lambda self, *columns: self), (lambda self, run, schema: run)

    class Task:
        get, partitionId = classmethod(lambda c: c), classmethod(lambda c: 0)

    def batches():
        for i in range(2100):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([" ".join(np.base_repr(j, 36).lower() for j in range(1000 * i, 1000 * i + 1000)) + " the" * 6000])], ["doc_id", "text"])

    def held(e):
        return sys.getsizeof(e.known) + sum(map(sys.getsizeof, e.known)) + 32 * len(e.known) + sum(x.nbytes for x in (e.pool, e.starts, e.sizes, e.uses))

    monkeypatch.setattr("pyspark.TaskContext", Task)
    token_ids._ENCODERS.clear()
    rows, most = 0, 0
    for b in huffman_ids.tokenize(Documents(), "byte_bpe_50k.json", str(tmp_path))(batches()):
        rows, most = rows + b.num_rows, max(most, held(token_ids._ENCODERS["byte_bpe_50k.json"]))
    token_ids._ENCODERS.clear()
    assert rows == 2100 and most < 200e6


def test_packing(spark, documents, nothing):
    out = bound_packing.pack_documents(spark, documents, capacity=128).collect()
    rows, want = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()], []
    for (i, _), ids in zip(rows, tokenized("word_bpe_49k.json", [t for _, t in rows])):
        want += [(i, k, lo, len(ids[lo : lo + 128]), zlib.crc32(np.array(ids[lo : lo + 128], "<u4").tobytes())) for k, lo in enumerate(range(0, len(ids), 128))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 128
    lengths = np.array([r["length"] for r in out])
    assert bound_packing.lower_bound(lengths, 128) <= len(bins) <= bound_packing.lower_bound(lengths, 128) + 2
    assert bound_packing.pack_documents(spark, nothing).count() == 0


def test_packing_exchanges_between_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 100, 3000))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    ws = Workspace(spark, "t")
    out = bound_packing.pack(ws, pieces, 100, part_rows=200).collect()
    bins = defaultdict(int)
    for r in out:
        bins[r["sequence_id"]] += r["length"]
    together = len(bound_packing.best_fit_decreasing(np.array([r[3] for r in rows]), 100)[2])
    assert len(out) == 3000 and max(bins.values()) <= 100 and len(bins) <= 1.015 * together  # partitions of 200 pieces are far smaller than in use


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_bound_never_exceeds_the_optimum(items):
    best = len(items)

    def place(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + left[0] <= 12:
                place(left[1:], bins[:i] + [bins[i] + left[0]] + bins[i + 1 :])
        place(left[1:], bins + [left[0]])

    place(sorted(items, reverse=True), [])
    bound = bound_packing.lower_bound(np.array(items), 12)
    b, offset, fill = bound_packing.best_fit_decreasing(np.array(items), 12)
    assert bound <= best <= len(fill) and fill.max() <= 12 and fill.sum() == sum(items)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_texts_of_the_corpus(spark, name):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    e = Encoder(tokenizer_file(name), keep=50_000)
    whole = e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert e.encode_all(texts) == [np.array(x.ids, "<u4").tobytes() for x in whole]
