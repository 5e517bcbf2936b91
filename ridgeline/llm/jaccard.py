"""Exact Jaccard join of documents on their word shingles, with set relations that skip work.

Shingles have one global order: rare before frequent. Two sets that link share a shingle in their prefixes of that
order. Prefixes are dealt by shingle as packed blocks, so each task holds whole index lists, sorted by size.

Round one compares every set of a list with one pivot of the list only. The answers (intersection sizes with the
pivot) then serve all pairs of the list: for sets x and y with pivot r,
    |x & r| + |y & r| - |r| <= |x & y| <= min(|x & r|, |y & r|) + min(|x - r|, |y - r|),
so most other pairs are decided without reading a set; sets that already are in one class are skipped, and so are
blocks of a list whose sizes or positions rule a link out. Long lists first meet a few pivots of their largest class,
round by round, as long as that joins classes; then all pairs that are still open are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import _bytes
from ridgeline.llm._common import place, stored

#: Words of a shingle, percent of the union that a link needs.
WIDTH, PERCENT = 5, 80
#: Prefix entries of a deal; cells of the frequency sketch, a byte each (the bound of what is broadcast), at least and at most; entries of a list up to
#: which all its pairs are looked at together.
DEALT, CELLS, SHORT = 500_000, (1 << 18, 1 << 24), 32
#: Pivots of a long list in a later round, and such rounds at most (what they leave is compared pair by pair).
PIVOTS, ROUNDS = 4, 6

#: Cells that one row brings to the driver; entries from which a list is cut into blocks of this many, every two of which
#: meet in a group of their own.
PACKED, BLOCK = 1 << 13, 2048

_ENTRY = np.dtype([("h", "<u8"), ("row", "<i8"), ("size", "<i4"), ("at", "<i4")])


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest intersection with which sets of sizes a and b link."""
    return -((-percent * (a + b)) // (100 + percent))


def _sets(batch, width: int):
    """first row, (hash, row within the chunk), sizes of each chunk of a batch with the columns row, text."""
    data, offsets = _bytes.buffers(batch.column("text"))
    for first, last in _bytes.chunks(offsets):
        words, rows = _bytes.word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1])
        hashes, owner = _bytes.shingles(words, rows, last - first, width)
        yield first, last, hashes, owner, np.bincount(owner, minlength=last - first)


def _measure(cells: int, width: int):
    """Rows (row, size) of the documents, and rows (cell, n) of the cells that several of a batch's shingles fall in."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            row, every = batch.column("row").to_numpy(), []
            for first, last, hashes, _, sizes in _sets(batch, width):
                every.append((hashes & np.uint64(cells - 1)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({"row": pa.array(row[first:last]), "size": pa.array(sizes, pa.int64()), "cell": pa.nulls(last - first, pa.int32()), "n": pa.nulls(last - first, pa.int32())})
            found, counts = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.int32),) * 2
            found, counts = found[counts > 1], counts[counts > 1].astype(np.int32)
            yield pa.RecordBatch.from_pydict({"row": pa.nulls(len(found), pa.int64()), "size": pa.nulls(len(found), pa.int64()), "cell": pa.array(found, pa.int32()), "n": pa.array(counts, pa.int32())})

    return run


def _grades(measured: DataFrame, cells: int) -> bytes:
    """A byte for each cell: twice the logarithm of its count, 0 for those that no batch met twice. Spark adds up the
    counts; the result has `cells` bytes at most."""
    counts = measured.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = counts.select(F.floor(F.col("cell") / PACKED).cast("int").alias("part"), (F.col("cell") % PACKED).alias("at"), F.floor(2 * F.log2("n")).cast("int").alias("grade"))
    out = bytearray(cells)
    for r in rows.groupBy("part").applyInPandas(_packed, "part int, grades binary").collect():
        out[r["part"] * PACKED : (r["part"] + 1) * PACKED] = r["grades"]
    return bytes(out)


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(PACKED, np.uint8)
    out[group["at"]] = group["grade"]
    return pd.DataFrame({"part": group["part"].iloc[:1], "grades": [out.tobytes()]})


def _entries(grades, width: int, percent: int, deals: int):
    """Packed prefix entries by deal. Shingles are ordered by grade of frequency, then hash."""

    def run(batches):
        import pyarrow as pa

        grade = np.frombuffer(grades.value, np.uint8)
        cells = np.uint64(len(grade) - 1)
        for batch in batches:
            row, held = batch.column("row").to_numpy(), []
            for first, last, hashes, owner, sizes in _sets(batch, width):
                order = np.lexsort((hashes, grade[(hashes & cells).astype(np.int64)], owner))
                hashes, owner = hashes[order], owner[order]
                start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                at = np.arange(len(hashes)) - start[owner]
                size = sizes[owner]
                keep = at <= size + (-percent * size) // 100
                out = np.empty(int(keep.sum()), _ENTRY)
                out["h"], out["row"], out["size"], out["at"] = hashes[keep], row[first:last][owner[keep]], size[keep], at[keep]
                held.append(out)
            if held:
                every = np.concatenate(held)
                yield from _dealt(every, every["h"], deals)

    return run


def _dealt(records: np.ndarray, key: np.ndarray, deals: int):
    """One row (deal, block) for each deal: records whose key falls there."""
    import pyarrow as pa

    deal = (_bytes.mix(key) % np.uint64(deals)).astype(np.int32)
    order = np.argsort(deal, kind="stable")
    records, deal = records[order], deal[order]
    found, starts = np.unique(deal, return_index=True)
    blocks = np.split(records, starts[1:])
    if len(found):
        yield pa.RecordBatch.from_pydict({"deal": pa.array(found, pa.int32()), "block": pa.array([b.tobytes() for b in blocks], pa.binary())})


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)


def _lists(percent: int):
    """Index lists of two sets or more: every entry with the pivot of its list, the set of least mixed number, and
    whether it asks for its overlap with the pivot, as they can link."""
    return lambda batches: _listed(batches, percent)


def _has_partner(e: np.ndarray, percent: int) -> np.ndarray:
    """Whether an entry can link with another one of its list; all entries of long lists count."""
    starts = _runs(e["h"])
    lengths = np.diff(starts)
    end, every = np.repeat(starts[1:], lengths), np.arange(len(e))
    out = np.repeat(lengths > SHORT, lengths)
    short = ~out
    for d in range(1, int(lengths[lengths <= SHORT].max(initial=1))):
        i = every[short & (every + d < end)]
        fits = _admissible(e["size"][i], e["size"][i + d], e["at"][i], e["at"][i + d], percent)
        out[i[fits]] = out[i[fits] + d] = True
    return out


def _listed(batches, percent: int):
    import pyarrow as pa

    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for deal, block in zip(batch.column("deal").to_pylist(), batch.column("block").to_pylist(), strict=True):
            held.setdefault(deal, []).append(block)
    for blocks in held.values():
        e = np.frombuffer(b"".join(blocks), _ENTRY)
        e = e[np.argsort(e["h"], kind="stable")]
        starts = _runs(e["h"])
        lengths = np.diff(starts)
        e = e[np.repeat(lengths > 1, lengths)]
        e = e[_has_partner(e, percent)]
        if not len(e):
            continue
        starts = _runs(e["h"])
        rank = _bytes.mix(e["row"].astype(np.uint64))
        run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.lexsort((rank, run))
        e = e[order]
        first = starts[:-1][run]
        for a in range(0, len(e), 100_000):
            part, pivot = e[a : a + 100_000], e[first[a : a + 100_000]]
            asks = _admissible(part["size"], pivot["size"], part["at"], pivot["at"], percent) & (part["row"] != pivot["row"])
            columns = {"h": part["h"].view(np.int64), "row": part["row"], "size": part["size"], "at": part["at"], "pivot": pivot["row"], "pivot_size": pivot["size"], "asks": asks}
            yield pa.RecordBatch.from_pydict({k: pa.array(np.ascontiguousarray(v)) for k, v in columns.items()})


def _pack_sets(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            row = batch.column("row").to_numpy()
            for first, last, hashes, _, sizes in _sets(batch, width):
                ends = np.cumsum(sizes) * 8
                raw = hashes.tobytes()
                packed = [raw[e - 8 * s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"row": pa.array(row[first:last]), "packed": pa.array(packed, pa.binary())})

    return run


def _overlaps(batches):
    """a, b, overlap for pairs with their packed sets; each set is sorted, so the larger one is searched."""
    import pyarrow as pa

    for batch in batches:
        sizes = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            sizes.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "overlap": pa.array(sizes, pa.int64())})


def _compared(pairs: DataFrame, sets: DataFrame, few: bool) -> DataFrame:
    """Intersection sizes of pairs (a, b) from the stored sets; of few pairs, only the sets that occur are moved (their
    rows are sent whole while they are small)."""
    if few:
        used = stored(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "used")
        sets = sets.join(used, "row", "left_semi")
    left = sets.select(F.col("row").alias("a"), F.col("packed").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("packed").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_overlaps, "a long, b long, overlap long")


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round on edges (a > b): every vertex tells its larger (or smaller) neighbours, in the second case itself
    too, of its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    told = both.join(least, "a")
    told = told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else told.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return stored(told.where("a != b").distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """row, label: the least row of its component, for rows that have an edge. Large and small stars in turn: each vertex
    links its larger neighbours, then its smaller ones, to the least of them, until every component is a star of its
    least row. The rounds grow with the logarithm of the longest path, not with the path; each is written, so a lost
    executor costs one round at most."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "stars")
    while True:
        # A star forest: no vertex has two smaller neighbours, or a smaller and a larger one.
        ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        loose = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
        if not loose.limit(1).count():
            break
        edges = _starred(_starred(edges, True), False)
    labels = edges.select(F.col("a").alias("row"), F.col("b").alias("label"))
    return labels.unionByName(edges.select(F.col("b").alias("row"), F.col("b").alias("label")).distinct())


def _with_links(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels (row, label) with further links (a, b): components of the classes that these join, so that links of
    earlier rounds aren't read again."""
    of = lambda c: labels.select(F.col("row").alias(c), F.col("label").alias(f"{c}_label"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    merged = components(ends)
    moved = labels.join(merged.select(F.col("row").alias("label"), F.col("label").alias("to")), "label", "left").select("row", F.coalesce("to", "label").alias("label"))
    return stored(moved.unionByName(merged.join(labels.select("row"), "row", "left_anti")), "labels")


def _admissible(a_size, b_size, a_at, b_at, percent: int):
    """Whether a and b can link with this shingle as their first common one: sizes are near enough, it stands in the
    shorter index prefix of the smaller set, and enough shingles follow in both. (Each pair that links meets at its
    first common shingle, so it may be passed over in other lists.)"""
    small, large = np.minimum(a_size, b_size), np.maximum(a_size, b_size)
    index = small - least_overlap(small, small, percent)
    small_at = np.where(a_size < b_size, a_at, np.where(a_size > b_size, b_at, np.minimum(a_at, b_at)))
    return (100 * small >= percent * large) & (small_at <= index) & (np.minimum(a_size - a_at, b_size - b_at) >= least_overlap(small, large, percent))


def _open_pairs(percent: int, turn: int | None):
    """Pairs of a list that are in two classes and not ruled out by their answers for the pivot: a, b, sure (ruled in).
    A group is a list, or two blocks of a long one. With a turn, only long lists, and there the pairs of the sets outside
    the largest class of the group with some of its sets."""

    def judged(e, i, j):
        i, j = i[e["label"][i] != e["label"][j]], j[e["label"][i] != e["label"][j]]
        size, at, o = e["size"], e["at"], e["overlap"]
        fits = _admissible(size[i], size[j], at[i], at[j], percent)
        i, j = i[fits], j[fits]
        need, known = least_overlap(size[i], size[j], percent), (o[i] >= 0) & (o[j] >= 0) & (e["pivot"][i] == e["pivot"][j])
        upper = np.minimum(o[i], o[j]) + np.minimum(size[i] - o[i], size[j] - o[j])
        keep = ~known | (upper >= need)
        i, j, need, known = i[keep], j[keep], need[keep], known[keep]
        sure = known & (o[i] + o[j] - e["pivot_size"][i] >= need)
        return pd.DataFrame({"a": np.minimum(e["row"][i], e["row"][j]), "b": np.maximum(e["row"][i], e["row"][j]), "sure": sure})

    def work(frame: pd.DataFrame):
        e = {c: frame[c].to_numpy() for c in frame.columns}
        starts = _runs(e["group"])
        lengths = np.diff(starts)
        end = np.repeat(starts[1:], lengths)
        short = np.repeat(lengths <= SHORT, lengths)
        every = np.arange(len(end))
        found = []
        for d in range(1, int(lengths[lengths <= SHORT].max(initial=1)) if turn is None else 1):
            i = every[short & (every + d < end)]
            found.append(judged(e, i, i + d))
        for a, b in zip(starts[:-1][lengths > SHORT].tolist(), starts[1:][lengths > SHORT].tolist(), strict=True):
            # Entries are sorted by size, so the blocks of the list that are too small or too large are skipped; pairs
            # within the largest class aren't looked at.
            labels, number, counts = np.unique(e["label"][a:b], return_inverse=True, return_counts=True)
            size = e["size"][a:b]
            if turn is not None:
                others, largest = np.flatnonzero(number != counts.argmax()), np.flatnonzero(number == counts.argmax())
                rank = _bytes.mix(e["row"][a:b][largest].astype(np.uint64) + np.uint64((turn + 1) << 48))
                for j in largest[np.argsort(rank)[:PIVOTS]].tolist():
                    found.append(judged(e, a + others, np.full(len(others), a + j)))
                continue
            block = e["block"][a:b]
            across = bool((block != block[0]).any())
            for i in np.flatnonzero(number != counts.argmax()).tolist():
                low, high = np.searchsorted(size, [-(-percent * int(size[i]) // 100), 100 * int(size[i]) // percent + 1])
                j = np.arange(low, high)
                j = j[(number[j] == counts.argmax()) | (j > i)]
                if across:  # pairs within a block meet in its own group
                    j = j[block[j] != block[i]]
                found.append(judged(e, np.full(len(j), a + i), a + j))
                if len(found) > 1000:
                    yield pd.concat(found).drop_duplicates()
                    found = []
        if found:
            yield pd.concat(found).drop_duplicates()

    def run(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rest["group"].to_numpy() == rest["group"].iloc[-1] if len(rest) else np.zeros(0, bool)
            if not last.all():
                yield from work(rest[~last])
                rest = rest[last]
        if rest is not None and len(rest):
            yield from work(rest)

    return run


def _blocked(lists: DataFrame) -> DataFrame:
    """Entries with group and block: a list is one group; of one with over BLOCK entries, every entry falls in a block by
    the hash of its row, and goes to the groups of its block with each block."""
    long = lists.groupBy("h").count().where(F.col("count") > BLOCK).select("h", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # One row for each list of over BLOCK entries.
    out = lists.join(long, "h", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("row"), F.col("blocks")), F.lit(0)).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return out.withColumn("group", F.xxhash64("h", F.least("block", "other"), F.greatest("block", "other"))).drop("blocks", "other", "h")


def _next_pow2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """row, doc_id, n_shingles, component_id and label (the least row of its class) of every document.

    docs must be a stored table: its rows are numbered by their place. Sets are distinct shingles of `width` words
    (A-Z lower-cased), by 64-bit hashes; a text with fewer words is one shingle, one without words (null, empty) has
    none and links with nothing. Equal texts link like others; rows with one doc_id stay different documents.
    component_id is the least doc_id that links reach, its own included (null only if none has an id).
    """
    spark = docs.sparkSession
    texts = docs.select(place(docs).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = docs.select(place(docs).alias("row"), F.col(doc_id).cast("long").alias("doc_id"))
    cells = min(CELLS[1], max(CELLS[0], _next_pow2(32 * docs.count())))
    measured = stored(texts.mapInArrow(_measure(cells, width), "row long, size long, cell int, n int"), "measured")
    sizes = measured.where("row is not null").select("row", "size")
    grades = spark.sparkContext.broadcast(_grades(measured, cells))
    total = sizes.agg(F.sum(F.col("size") - F.ceil(F.col("size") * percent / 100) + 1)).first()[0] or 0
    deals = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // DEALT))

    entries = texts.mapInArrow(_entries(grades, width, percent, deals), "deal int, block binary").repartition(deals, "deal")
    lists = stored(entries.mapInArrow(_lists(percent), "h long, row long, size int, at int, pivot long, pivot_size int, asks boolean"), "lists")
    pairs = stored(lists.where("asks").select(F.col("row").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    # The same plan at every size: texts of the documents in lists are moved once.
    used = lists.select("row").distinct()
    sets = stored(texts.join(used.hint("merge"), "row").select("row", "text").mapInArrow(_pack_sets(width), "row long, packed binary"), "sets")
    answers = stored(_compared(pairs, sets, False), "answers")
    size_of = lambda c: sizes.select(F.col("row").alias(c), F.col("size").alias(f"{c}_size"))
    linked = lambda df: df.where(100 * F.col("overlap") >= percent * (F.col("a_size") + F.col("b_size") - F.col("overlap"))).select("a", "b")
    links = stored(linked(answers.join(size_of("a"), "a").join(size_of("b"), "b")), "links")
    labels = components(links)

    # What is left: lists that hold two classes or more.
    labelled = lambda df: df.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    mixed = labelled(lists.select("h", "row")).groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("h")
    known = lists.join(stored(mixed, "mixed"), "h").join(answers.select(F.col("a").alias("row"), F.col("b").alias("pivot"), "overlap"), ["row", "pivot"], "left")
    overlap = F.when(F.col("row") == F.col("pivot"), F.col("size").cast("long")).otherwise(F.coalesce("overlap", F.lit(-1)))
    known = stored(_blocked(known.select("h", "row", *[F.col(c).cast("long").alias(c) for c in ("size", "at", "pivot", "pivot_size")], overlap.alias("overlap"))), "known")
    turn: int | None = 0
    while True:
        ordered = labelled(known).repartition("group").sortWithinPartitions("group", "size", "row")
        open_ = ordered.mapInPandas(_open_pairs(percent, turn), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))
        open_ = stored(open_, "open")
        joined = False
        if open_.limit(1).count():
            more = linked(_compared(open_.where("not sure"), sets, True).join(size_of("a"), "a").join(size_of("b"), "b"))
            more = stored(more.unionByName(open_.where("sure").select("a", "b")), "links")
            joined = bool(more.limit(1).count())
        if joined:
            labels = _with_links(labels, more)
        if turn is None:
            break
        turn = turn + 1 if joined and turn + 1 < ROUNDS else None

    out = ids.join(sizes, "row").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    least = stored(out.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    return out.join(least, "label").select("row", "doc_id", F.col("size").alias("n_shingles"), "component_id", "label")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class: that of least id (then of first place); documents without words stay."""
    found = classes(docs, doc_id, text, **options)
    chosen = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("_rl_kept"))
    numbered = docs.select(F.struct(*docs.columns).alias("d"), place(docs).alias("_rl_kept"))
    return numbered.join(chosen, "_rl_kept").select("d.*")
