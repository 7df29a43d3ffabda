"""Line dedup: a segment-partition edit join over all lines of the corpus.

Two lines are near if their edit distance is at most ``edits`` and at most a fifth of the longer one.  A line of
``l`` characters is split into ``t + 1`` even segments, ``t`` the edits its length allows; a near line at least as
long holds one of the segments unchanged at a place that the difference in length confines.  So every
line puts its segments into an index keyed by (length, number, segment) and probes the indexes of the
lengths in reach with the substrings at those places.  Candidates are verified by a banded
bit-parallel edit distance.

Links join lines into classes.  Of each class the first occurrence, by (doc_id, line number), stays; all other
occurrences go.  Blank lines are no lines here and stay.

Scale.  Equal lines are one node.  Index and probe rows carry two numbers; texts are fetched only for lines
that share a key with another line.  Within a key, a line is compared only with classes it is not in yet,
so a key yields fewer links than lines.  A key of more than ``SPLIT`` lines is cut into pieces, by two hashes, whose
lines are joined first; where that leaves one class, as among numbered lines, it is done.  Else, if few lines lie outside the
largest class, these meet every piece; if many do, the key is split by the
segments of what remains of its lines beside the shared one, and so on; what is left at the last depth meets block by block.
No task ever compares more than about ``SPLIT`` lines with as many.

Defined results: a null text stays null and has no lines; a document without a kept line has an empty text; rows
that share id and text keep the same lines; a null ``doc_id`` comes last; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.llm.runtime import Workspace, connected_components, small_enough

SPLIT = 2048
_DEPTH = 4
_SALTS = 16
#: Rows that a task gathers before it hands them on, characters of lines likewise, and lines that it remembers having met.
_ROWS = 1 << 17
_CHARS = 4 << 20
_SEEN = 1 << 20


def allowed(length: int, edits: int) -> int:
    """The edits that a pair may have whose longer line has this length."""
    return min(edits, length // 5)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the segments of an indexed line: one more than the edits of any partner."""
    return _even(length, min(edits, (length + edits) // 5) + 1)


def _even(length: int, n: int) -> list[tuple[int, int]]:
    base, longer = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = base + (i >= n - longer)
        out.append((at, size))
        at += size
    return out


def places(length: int, other: int, edits: int) -> list[tuple[int, int, int]]:
    """(number, start, size) of the substrings with which a line probes the index of length ``other``.

    With ``i`` segments before the shared one, at most ``i`` edits lie before it and at most ``t - i`` behind it.
    """
    return _places(segments(other, edits), length, length - other)


def _places(parts: list[tuple[int, int]], length: int, shift: int) -> list[tuple[int, int, int]]:
    t = len(parts) - 1
    out = []
    for i, (p, size) in enumerate(parts):
        for q in range(max(0, p - i, p + shift - (t - i)), min(length - size, p + i, p + shift + (t - i)) + 1):
            out.append((i, q, size))
    return out


_PLACES: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}


def rest_keys(rest: str, edits: int, under: int) -> list[tuple[int, int, int]]:
    """(key, start, size) below a shared segment, of what remains of a line: two rests within ``edits`` share a key.

    Here the edits do not depend on the length, which is that of a part; rests too short for so many segments
    share one key with those a little longer.
    """
    raw, n, digest = rest.encode("utf-32-le", "surrogatepass"), len(rest), xxhash.xxh3_64_intdigest
    out = [(under ^ 0x5DEECE66D, 0, 0)] if n <= 2 * edits else []
    for other in range(max(edits + 1, n - edits), n + 1):
        parts = _even(other, edits + 1)
        for i, q, size in _places(parts, n, n - other):
            out.append((digest(raw[4 * q : 4 * (q + size)], under ^ (other << 3 | i)), q, size))
    return out


def keys_of(text: str, edits: int, under: int = 0) -> list[tuple[int, int, int, int]]:
    """(key, kind, start, size) of a line: kind 0 enters the index (and probes its own place), 1 probes."""
    raw, n, digest = text.encode("utf-32-le", "surrogatepass"), len(text), xxhash.xxh3_64_intdigest
    out = []
    for i, (p, size) in enumerate(segments(n, edits)):
        out.append((digest(raw[4 * p : 4 * (p + size)], under ^ (n << 3 | i)), 0, p, size))
    own = {(i, p) for i, (p, _) in enumerate(segments(n, edits))}
    for other in range(max(1, n - allowed(n, edits)), n + 1):
        if (found := _PLACES.get((n, other, edits))) is None:
            if len(_PLACES) > 100_000:
                _PLACES.clear()
            found = _PLACES[n, other, edits] = places(n, other, edits)
        for i, q, size in found:
            if other < n or (i, q) not in own:
                out.append((digest(raw[4 * q : 4 * (q + size)], under ^ (other << 3 | i)), 1, q, size))
    return out


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``: Myers' bit vectors on the band of 2k + 1 diagonals."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    lo, most = 0, len(b)
    while lo < most and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not b:
        return len(a) <= k
    if len(a) <= k:
        return True
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    width = 2 * k + 2
    full, top = (1 << width) - 1, width - 1
    up, down = full & ~((1 << (width - k - 1)) - 1), 0  # vertical differences of +1 and -1
    score, row = k, 1 << (top - 1)
    for j, c in enumerate(b):
        first = j + k - top
        held = at.get(c, 0)
        same = (held >> first if first >= 0 else held << -first) & full
        flat = ((((same & up) + up) ^ up) | same | down) & full  # no difference along the diagonal
        right_up, right_down = (down | ~(flat | up)) & full, flat & up
        if j < len(a) - k:  # the band's top diagonal runs down to the last character of a
            score += not flat >> top & 1
        else:
            score += (right_up & row > 0) - (right_down & row > 0)
            row >>= 1
        up, down = (right_down | ~(flat >> 1 | right_up)) & full, flat >> 1 & right_up
        if score > 2 * k:  # what is left of the bottom row takes off k at most
            return False
    return score <= k


def near(a: str, b: str, edits: int) -> bool:
    return within(a, b, allowed(max(len(a), len(b)), edits))


def line_id(line: str) -> int:
    """63 bits of a hash, as an even signed long; the lowest bit is free for the kind of a key."""
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) & ~1
    return h - (1 << 64) if h >> 63 else h


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def occurrences(documents: DataFrame) -> DataFrame:
    """``row, doc_id, pos, id`` of every line that is not blank; ``row`` names (doc_id, text)."""

    def out(rows, docs, places, ids):
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int32()), pa.array(ids, pa.int64())], ["row", "doc_id", "pos", "id"])

    def run(batches):
        rows, docs, places, ids = [], [], [], []
        for b in batches:
            for row, doc, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                for i, line in enumerate((text or "").split("\n")):
                    if line and not line.isspace():
                        rows.append(row)
                        docs.append(doc)
                        places.append(i)
                        ids.append(line_id(line))
                if len(rows) >= _ROWS:
                    yield out(rows, docs, places, ids)
                    rows, docs, places, ids = [], [], [], []
        yield out(rows, docs, places, ids)

    return documents.select(_row().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, pos int, id long")


def _row():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def shared_keys(documents: DataFrame, edits: int) -> DataFrame:
    """``key, id`` (kind in the lowest bit) of the keys that an indexed line shares with another line."""

    def emit(batches):
        seen: set[int] = set()  # ids of this partition's lines; once full it starts anew, and a line met again only comes twice
        keys, ids = [], []
        for b in batches:
            for text in b.column("text").to_pylist():
                for line in (text or "").split("\n"):
                    if not line or line.isspace() or (own := line_id(line)) in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(own)
                    for key, kind, _, _ in keys_of(line, edits):
                        keys.append(_signed(key))
                        ids.append(own | kind)
                    if len(keys) >= _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], ["key", "id"])
                        keys, ids = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], ["key", "id"])

    def pick(batches):
        tail_k, tail_i = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(k, i):
            if not len(k):
                return None
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            line = i & ~1
            several = np.minimum.reduceat(line, start) != np.maximum.reduceat(line, start)
            indexed = np.minimum.reduceat(i & 1, start) == 0
            keep = np.repeat(several & indexed, np.diff(np.r_[start, len(k)]))
            return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(i[keep])], ["key", "id"])

        for b in batches:
            k, i = np.r_[tail_k, b.column("key").to_numpy()], np.r_[tail_i, b.column("id").to_numpy()]
            cut = np.searchsorted(k, k[-1]) if len(k) else 0  # the last key may go on in the next batch
            if cut:
                yield out(k[:cut], i[:cut])
            tail_k, tail_i = k[cut:], i[cut:]
        if (last := out(tail_k, tail_i)) is not None:
            yield last

    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("text").mapInArrow(emit, "key long, id long")
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(pick, "key long, id long").distinct()


def _profile(texts: list[str]) -> np.ndarray:
    """Counts of character classes; two lines within k edits differ by at most 2k in sum."""
    out = np.zeros((len(texts), 32), np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") & 31, minlength=32)
    return out


def link_within(ids: list[int], texts: list[str], edits: int) -> list[tuple[int, int]]:
    """Links that join all near lines of one key; fewer than there are lines."""
    links: list[tuple[int, int]] = []
    group = np.arange(len(ids))
    sizes, profile = np.array([len(t) for t in texts]), _profile(texts)
    for i in range(1, len(ids)):
        at = np.flatnonzero(np.abs(sizes[:i] - sizes[i]) <= edits)
        at = at[np.abs(profile[at] - profile[i]).sum(1) <= 2 * edits]
        for j in at.tolist():
            if group[i] != group[j] and near(texts[i], texts[j], edits):
                links.append((ids[i], ids[j]))
                group[group == group[j]] = group[i]
    return links


def links(spark: SparkSession, ws: Workspace, documents: DataFrame, edits: int) -> DataFrame:
    """``a, b``: links between different lines that join exactly the near ones."""
    shared = ws.table(shared_keys(documents, edits), "shared")
    wanted = ws.table(shared.select(F.expr("shiftleft(shiftright(id, 1), 1)").alias("want")).distinct(), "wanted")
    few = small_enough(spark, wanted.count(), 16, 32 << 20)

    def lines(batches):
        found, size = {}, 0
        for b in batches:
            for t in b.column("text").to_pylist():
                found.update({line_id(x): x for x in (t or "").split("\n") if x and not x.isspace()})
                size += len(t or "")
                if size >= _CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["line", "words"])
                    found, size = {}, 0
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["line", "words"])

    every = documents.select("text").mapInArrow(lines, "line long, words string")
    texts = every.join(F.broadcast(wanted) if few else wanted, F.col("line") == F.col("want"), "left_semi")
    texts = ws.table(texts.groupBy("line").agg(F.first("words").alias("words")), "texts")
    members = shared.select("key", F.expr("shiftleft(shiftright(id, 1), 1)").alias("line"), F.col("id").bitwiseAND(F.lit(1)).cast("int").alias("kind")).distinct()
    members = ws.table(members.join(texts, "line").select("key", "kind", "line", "words", F.lit(None).cast("string").alias("rest")), "members")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out: list[DataFrame] = []

    def verify(rows: DataFrame, check, *order: str) -> None:
        out.append(ws.table(rows.repartition(n, "key").sortWithinPartitions("key", *order).mapInArrow(check, "a long, b long"), "links"))

    for depth in range(_DEPTH):
        counts = members.groupBy("key").agg(F.count("*").alias("n"))
        hot = ws.table(counts.where(F.col("n") > SPLIT).select(F.col("key").alias("hot"), F.ceil(F.col("n") / SPLIT).alias("pieces")), "hot")
        if hot.isEmpty():
            verify(members.select("key", "line", "words"), _verify(edits), "line")
            break
        verify(members.join(hot, F.col("key") == F.col("hot"), "left_anti").select("key", "line", "words"), _verify(edits), "line")
        many = ws.table(members.drop("comp").join(hot, F.col("key") == F.col("hot")).drop("hot"), "many")
        for turn in range(2):
            piece = F.pmod(F.xxhash64("line", F.lit(turn)), F.col("pieces"))
            verify(many.select(F.xxhash64("key", piece, F.lit(turn)).alias("key"), "line", "words"), _verify(edits), "line")
        roots = connected_components(ws, _union(out))
        tagged = many.join(roots, F.col("line") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "line")).drop("node", "component")
        tagged = ws.table(tagged, "tagged")
        sizes = tagged.select("key", "line", "comp").distinct().groupBy("key", "comp").agg(F.count("*").alias("c"))
        mixed = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("others"))
        mixed = ws.table(mixed.where("others > 0").withColumnRenamed("key", "open"), "mixed")
        if mixed.isEmpty():
            break
        meets = F.lit(depth == _DEPTH - 1) | (F.col("others") <= SPLIT)
        meeting = tagged.join(mixed.where(meets), F.col("key") == F.col("open"))
        blocks = F.ceil(F.col("others") / SPLIT)
        own = meeting.select("key", F.pmod(F.xxhash64("line"), F.col("pieces")).alias("piece"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(0).alias("star"), "line", "words", "comp")
        stars = meeting.where("comp <> main").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("line", F.lit(7)), blocks).alias("block"), F.lit(1).alias("star"), "line", "words", "comp")
        verify(own.unionByName(stars).select(F.xxhash64("key", "piece", "block").alias("key"), "star", "line", "words", "comp"), _across(edits), "star", "line")
        finer = tagged.join(mixed.where(~meets), F.col("key") == F.col("open"), "left_semi").select("key", "kind", "line", "words", "rest", "comp")
        finer = ws.table(finer.mapInArrow(_refine(edits), "key long, kind int, line long, words string, rest string, comp long"), "finer")
        apart = finer.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("key").alias("open"))
        members = ws.table(finer.join(apart, F.col("key") == F.col("open"), "left_semi"), "members")
        ws.drop(many, tagged, finer)
        if members.isEmpty():
            break
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def link_across(own: list[tuple[int, str, int]], stars: list[tuple[int, str, int]], edits: int) -> list[tuple[int, int]]:
    """Links that join the near lines between two lists of (line, words, class), none within a class."""
    links: list[tuple[int, int]] = []
    if not own or not stars:
        return links
    sizes, profile = np.array([len(t) for _, t, _ in own]), _profile([t for _, t, _ in own])
    group = np.array([c for *_, c in own + stars])
    theirs = _profile([t for _, t, _ in stars])
    for j, (line, text, _) in enumerate(stars, len(own)):
        at = np.flatnonzero((np.abs(sizes - len(text)) <= edits) & (group[: len(own)] != group[j]))
        at = at[np.abs(profile[at] - theirs[j - len(own)]).sum(1) <= 2 * edits]
        for i in at.tolist():
            if group[i] != group[j] and near(text, own[i][1], edits):
                links.append((line, own[i][0]))
                group[group == group[i]] = group[j]
    return links


def _across(edits: int):
    def run(batches):
        key, sides = None, ([], [])
        for b in batches:
            found: list[tuple[int, int]] = []
            for k, star, line, words, comp in zip(*(b.column(c).to_pylist() for c in ("key", "star", "line", "words", "comp"))):
                if k != key:
                    found += link_across(*sides, edits)
                    key, sides = k, ([], [])
                if not sides[star] or sides[star][-1][0] != line:
                    sides[star].append((line, words, comp))
            yield _links(found)
        yield _links(link_across(*sides, edits))

    return run


def _verify(edits: int):
    def run(batches):
        key, ids, texts = None, [], []
        for b in batches:
            found: list[tuple[int, int]] = []
            for k, line, words in zip(*(b.column(c).to_pylist() for c in ("key", "line", "words"))):
                if k != key:
                    found += link_within(ids, texts, edits)
                    key, ids, texts = k, [], []
                if not ids or ids[-1] != line:
                    ids.append(line)
                    texts.append(words)
            yield _links(found)
        yield _links(link_within(ids, texts, edits))

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _refine(edits: int):
    """Split a key by what stands beside the shared segment: lines near each other share a segment there too."""

    def rests(key: int, kind: int, words: str, rest: str | None) -> list[str]:
        if rest is not None:
            return [rest]
        return [words[:at] + words[at + size :] for k, kd, at, size in keys_of(words, edits) if k == key and kd == kind]

    def run(batches):
        names = ("key", "kind", "line", "words", "rest", "comp")
        for b in batches:
            rows = []
            for key, kind, line, words, rest, comp in zip(*(b.column(c).to_pylist() for c in names)):
                whole = key & 0xFFFFFFFFFFFFFFFF
                for r in rests(whole, kind, words, rest):
                    rows += [(_signed(finer), 0, line, words, r[:at] + r[at + size :], comp) for finer, at, size in rest_keys(r, edits, whole)]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()))], list(names))

    return run


def dropped(spark: SparkSession, ws: Workspace, documents: DataFrame, edits: int) -> DataFrame:
    """``__gone_row, __gone``: the numbers of the lines that go, of each (doc_id, text) that loses any."""
    lines = ws.table(occurrences(documents), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos", "row")
    firsts = ws.table(lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n")), "firsts")
    classes = connected_components(ws, links(spark, ws, documents, edits)).select(F.col("node").alias("id"), "component")
    named = ws.table(firsts.join(classes, "id", "left").where("n > 1 or component is not null").select("id", F.coalesce("component", "id").alias("class"), "first"), "named")
    keep = ws.table(named.groupBy("class").agg(F.min("first").alias("keep")), "keep")
    if small_enough(spark, keep.count(), 40):
        kept = named.join(F.broadcast(keep), "class")
    else:  # a class may hold any share of the lines: its members are dealt with salts
        salted = keep.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        kept = named.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).join(salted, ["class", "salt"])
    keepers = ws.table(kept.select(F.col("id").alias("line"), F.col("keep.row").alias("keep_row"), F.col("keep.pos").alias("keep_pos")), "keepers")
    gone = lines.join(keepers, F.col("id") == F.col("line")).where("row <> keep_row or pos <> keep_pos").select("row", "pos").distinct()
    return ws.table(gone.groupBy("row").agg(F.collect_set("pos").alias("__gone")).select(F.col("row").alias("__gone_row"), "__gone"), "gone")


def dedup(spark: SparkSession, documents: DataFrame, edits: int = 2) -> DataFrame:
    """All columns of ``documents``, ``text`` (and ``n_chars``, if there is one) without the lines that go,
    and ``__lines``, ``__kept``: how many lines a text had and has, blank ones included."""
    ws = Workspace(spark, "lines")
    gone = dropped(spark, ws, documents, edits)
    spark._jvm.System.gc()  # lets Spark's cleaner free the shuffle files of the steps above
    # whatever the size, the lists of lines are what is hashed, and the texts stream past them unsorted
    joined = documents.withColumn("__row", _row()).join(gone.hint("shuffle_hash"), F.col("__row") == F.col("__gone_row"), "left")
    at, size = documents.columns.index("text"), documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def rebuild(batches):
        for b in batches:
            texts, lines, kept = [], [], []
            for text, lost in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                n = text.count("\n") + 1 if text is not None else 0
                if lost:
                    lost = set(lost)
                    text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in lost])
                texts.append(text)
                lines.append(n)
                kept.append(n - len(lost or ()))
            columns = b.columns[:-1]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int32()), pa.array(kept, pa.int32())], [*b.schema.names[:-1], "__lines", "__kept"])

    schema = StructType([*documents.schema.fields, StructField("__lines", IntegerType()), StructField("__kept", IntegerType())])
    return joined.select(*(F.col(f"`{c}`") for c in documents.columns), "__gone").mapInArrow(rebuild, schema)
