"""Removal of repeated passages by sparse suffix sorting.

Every string of LENGTH bytes has one anchor that its content picks: the leftmost of its K-byte pieces with the least
hash. So equal strings have equal anchors at equal offsets, and it is enough to order the text around anchors. Anchors
are dealt by hash as packed blocks. Anchors whose whole surroundings are equal are settled there: all but the first are
repeats. The others send their surroundings, and the suffixes to the right and the reversed prefixes to the left of
the anchors are ordered by deep-shallow sorting: multikey quicksort to a shallow depth, then a blind trie for
each group that is still together. Order and common prefixes tell for each offset which strings are equal, exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import _bytes
from ridgeline.llm._common import place, stored

#: Bytes of a repeated string and of an anchor; bytes that the shallow sort looks at; anchors and surroundings of a deal.
LENGTH, K, SHALLOW, DEALT, SHOWN = 100, 20, 16, 500_000, 50_000
#: Places of an anchor in a string; bytes to each side of an anchor.
PLACES = LENGTH - K + 1
SIDE = PLACES - 1
_BITS = np.uint64(28)

_SHOWN = np.dtype([("h", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("text", "u1", (2 * SIDE + K,))])


def anchors(data: np.ndarray, offsets: np.ndarray):
    """row, position in the row, hash and hash of the surroundings of every anchor; data starts at offsets[0]."""
    n, offsets = len(data), offsets - offsets[0]
    size = np.diff(offsets)
    if n < LENGTH or not (size >= LENGTH).any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_bytes.RAW[data] * _bytes.powers(_bytes.BASE, n), out=prefix[1:])
    back = _bytes.powers(_bytes.INVERSE, n + 1)
    hashed = _bytes.mix((prefix[K:] - prefix[:-K]) * back[: n - K + 1])
    # Sliding minimum over PLACES pieces, by running minima within blocks; the position breaks ties to the left.
    value = (hashed & ~np.uint64((1 << 28) - 1)) | np.arange(len(hashed), dtype=np.uint64)
    padded = np.full(-(-len(value) // PLACES) * PLACES, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    blocks = padded.reshape(-1, PLACES)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - LENGTH + 1], ahead[PLACES - 1 : PLACES + n - LENGTH])
    inside = np.ones(len(least), bool)
    for end in offsets[1:-1]:  # strings don't cross rows
        inside[max(0, end - LENGTH + 1) : end] = False
    at = np.unique((least[inside] & np.uint64((1 << 28) - 1)).astype(np.int64))
    row = np.searchsorted(offsets, at, "right") - 1
    start, stop = np.maximum(at - SIDE, offsets[row]), np.minimum(at + K + SIDE, offsets[row + 1])
    around = (prefix[stop] - prefix[start]) * back[start] + (at - start).astype(np.uint64) * np.uint64(_bytes.BASE) + (stop - at).astype(np.uint64)
    return row, at - offsets[row], hashed[at], _bytes.mix(around)


def _find(deals: int):
    """Blocks of anchors by deal, column by column: h, around, row, doc, pos."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = _bytes.buffers(batch.column("text"))
            row, doc = batch.column("row").to_numpy(), batch.column("doc").to_numpy()
            held = []
            for first, last in _bytes.chunks(offsets):
                r, pos, h, around = anchors(data[offsets[first] : offsets[last]], offsets[first : last + 1])
                held.append((h, around, row[first:last][r], doc[first:last][r], pos.astype(np.int32)))
            columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else []
            if held and len(columns[0]):
                deal = (columns[0] % np.uint64(deals)).astype(np.int32)
                order = np.argsort(deal, kind="stable")
                found, starts = np.unique(deal[order], return_index=True)
                cuts = [np.split(c[order], starts[1:]) for c in columns]
                blocks = [np.int64(len(p[0])).tobytes() + b"".join(np.diff(c, prepend=c.dtype.type(0)).tobytes() if c.dtype == np.int64 else c.tobytes() for c in p) for p in zip(*cuts, strict=True)]
                yield pa.RecordBatch.from_pydict({"deal": pa.array(found, pa.int32()), "block": pa.array(blocks, pa.binary())})

    return run


def _unpacked(block: bytes):
    n, at, out = int(np.frombuffer(block, np.int64, 1)[0]), 8, []
    for kind in ("<u8", "<u8", "<i8", "<i8", "<i4"):
        c = np.frombuffer(block, kind, n, at)
        out.append(np.cumsum(c) if kind == "<i8" else c)
        at += c.nbytes
    return out


def _blocks(batches):
    """All blocks of a deal at a time."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for deal, block in zip(batch.column("deal").to_pylist(), batch.column("block").to_pylist(), strict=True):
            held.setdefault(deal, []).append(block)
    while held:
        yield held.popitem()[1]


def _meet(batches):
    """Anchors that occur twice or more: row, pos, h. h is null where the surroundings are those of an earlier anchor;
    the first of each surroundings is returned only if its anchor has different ones."""
    import pyarrow as pa

    for blocks in _blocks(batches):
        h, around, row, doc, pos = (np.concatenate(c) for c in zip(*map(_unpacked, blocks), strict=True))
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h), bool)
        same[1:] = h[order][1:] == h[order][:-1]
        same[:-1] |= same[1:]
        h, around, row, doc, pos = (c[order[same]] for c in (h, around, row, doc, pos))
        if not len(h):
            continue
        order = np.lexsort((pos, row, doc, around, h))
        h, around, row, pos = (c[order] for c in (h, around, row, pos))
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_h | np.concatenate([[True], around[1:] != around[:-1]])
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_h))[np.cumsum(new_h) - 1]
        keep = ~new | (kinds > 1)
        yield pa.RecordBatch.from_pydict({"row": pa.array(row[keep]), "pos": pa.array(pos[keep]), "h": pa.array(h[keep].view(np.int64), mask=~new[keep])})


def _show(deals: int):
    """Blocks of surroundings by deal."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            held = []
            for row, doc, text, places, hashes in zip(*(batch.column(c).to_pylist() for c in ("row", "doc", "text", "places", "hashes")), strict=True):
                out = np.zeros(len(places), _SHOWN)
                out["h"], out["row"], out["doc"], out["pos"] = np.array(hashes, np.int64).view(np.uint64), row, doc, places
                for k, at in enumerate(places):
                    left, right = min(at, SIDE), min(len(text) - at - K, SIDE)
                    piece = np.frombuffer(text, np.uint8, left + K + right, at - left)
                    out["text"][k, SIDE - left : SIDE + K + right] = piece
                    out["left"][k], out["right"][k] = left, right
                held.append(out)
            if held:
                every = np.concatenate(held)
                deal = (_bytes.mix(every["h"]) % np.uint64(deals)).astype(np.int32)
                order = np.argsort(deal, kind="stable")
                found, starts = np.unique(deal[order], return_index=True)
                yield pa.RecordBatch.from_pydict({"deal": pa.array(found, pa.int32()), "block": pa.array([b.tobytes() for b in np.split(every[order], starts[1:])], pa.binary())})

    return run


class BlindTrie:
    """Orders byte strings. Inner nodes know only where their strings part; a string is compared in full once."""

    def __init__(self):
        self.root = None

    def add(self, key: int, text: bytes) -> None:
        if self.root is None:
            self.root = [text, [key]]
            return
        node = self.root
        while len(node) == 3:
            depth, branches = node[0], node[1]
            node = branches.get(text[depth] if depth < len(text) else -1) or node[2]
        other = node[0]
        n = min(len(text), len(other))
        differ = int.from_bytes(text[:n], "big") ^ int.from_bytes(other[:n], "big")
        common = n - (differ.bit_length() + 7) // 8
        if common == n and len(text) == len(other):
            node[1].append(key)
            return
        parent, node = None, self.root
        while len(node) == 3 and node[0] < common:
            parent = (node, text[node[0]])
            node = node[1][text[node[0]]]
        leaf, mark = [text, [key]], text[common] if common < len(text) else -1
        if len(node) == 3 and node[0] == common:
            node[1][mark] = leaf
            return
        inner = [common, {mark: leaf, (other[common] if common < len(other) else -1): node}, leaf]
        if parent is None:
            self.root = inner
        else:
            parent[0][1][parent[1]] = inner

    def order(self) -> list[int]:
        """Keys in the order of their strings."""
        keys, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if len(node) == 2:
                keys += node[1]
            else:
                todo += [node[1][m] for m in sorted(node[1], reverse=True)]
        return keys


def quicksorted(texts: np.ndarray, lengths: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of all groups side by side, to a depth: the order by group and text, and the number of the
    part of each place. Each round parts every open group in three by one byte of its middle string, the pivot: lower
    ones, equal ones, which go on with the next byte, and higher ones. An end is lower than every byte."""
    order = np.argsort(group, kind="stable")
    part = np.cumsum(np.concatenate([[0], (group[order][1:] != group[order][:-1]).astype(np.int64)])) if len(order) else np.zeros(0, np.int64)
    at = np.zeros(len(order), np.int64)  # bytes that a place's part has in common
    open_ = np.arange(len(order))
    while True:
        # Places of parts with more than one string that are not at the depth or at their end; parts stay contiguous.
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(part)))
        run = np.repeat(np.arange(len(starts)), size)
        open_ = np.flatnonzero((size[run] > 1) & (at >= 0) & (at < depth))
        if not len(open_):
            return order, part
        here, row = at[open_], order[open_]
        byte = np.where(here < lengths[row], texts[row, np.minimum(here, texts.shape[1] - 1)].astype(np.int64) + 1, 0)
        every = np.zeros(len(part), np.int64)
        every[open_] = byte
        pivot = every[(starts + size // 2)[run[open_]]]
        side = np.sign(byte - pivot)
        sub = np.lexsort((side, run[open_]))
        order[open_], side = row[sub], side[sub]
        # Equal strings that have ended stay together for good.
        at[open_] = np.where(side == 0, np.where(pivot[sub] == 0, -1, here[sub] + 1), here[sub])
        key = part * 3
        key[open_] += side + 1
        part = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))


def deep_shallow(texts: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by group and text, and the common prefix of each with the one before it (-1: none).

    Shallow: multikey quicksort of all groups to SHALLOW bytes. Deep: a blind trie for each part that is still together.
    Common prefixes are those of neighbours in the final order.
    """
    order, part = quicksorted(texts, lengths, group, SHALLOW)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(starts[:-1][np.diff(starts) > 1].tolist(), starts[1:][np.diff(starts) > 1].tolist(), strict=True):
        trie = BlindTrie()
        for i in order[a:b].tolist():
            trie.add(i, texts[i, : lengths[i]].tobytes())
        order[a:b] = trie.order()
    common = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        left, right = order[:-1], order[1:]
        differ = texts[left] != texts[right]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), texts.shape[1])
        shared = np.minimum(shared, np.minimum(lengths[left], lengths[right]))
        common[1:] = np.where(group[left] == group[right], shared, -1)
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each string the number of its class of equal prefixes of `depth` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeats(shown: np.ndarray) -> np.ndarray:
    """Which strings around anchors repeat an earlier one: shown is in text order; (anchor, offset of the anchor)."""
    left, right = shown["left"].astype(np.int64), shown["right"].astype(np.int64)
    # Anchors of one hash are of one group; those of one group are equal, so what follows them is sorted.
    anchor = np.ascontiguousarray(shown["text"][:, SIDE : SIDE + K]).view(f"V{K}").ravel()
    group = np.unique(np.rec.fromarrays([shown["h"], anchor.view(f"S{K}")]), return_inverse=True)[1] if len(shown) else np.zeros(0, np.int64)
    after = deep_shallow(np.ascontiguousarray(shown["text"][:, SIDE + K :]), right, group)
    before = deep_shallow(np.ascontiguousarray(shown["text"][:, :SIDE][:, ::-1]), left, group)
    out = np.zeros((len(shown), PLACES), bool)
    for offset in range(PLACES):
        on = np.flatnonzero((left >= offset) & (right >= LENGTH - K - offset))
        key = _classes(*before, offset)[on] * np.int64(len(shown) + 1) + _classes(*after, LENGTH - K - offset)[on]
        sub = np.argsort(key, kind="stable")
        again = np.zeros(len(on), bool)
        again[sub[1:]] = key[sub][1:] == key[sub][:-1]
        out[on[again], offset] = True
    return out


def _settle(batches):
    """row, start, end of what repeats around each anchor."""
    import pyarrow as pa

    for blocks in _blocks(batches):
        shown = np.frombuffer(b"".join(blocks), _SHOWN)
        shown = shown[np.lexsort((shown["pos"], shown["row"], shown["doc"]))]
        again = repeats(shown)
        some = again.any(axis=1)
        last, first = PLACES - 1 - again[:, ::-1].argmax(axis=1), again.argmax(axis=1)
        yield pa.RecordBatch.from_pydict({"row": pa.array(shown["row"][some]), "start": pa.array((shown["pos"] - last)[some].astype(np.int64)), "end": pa.array((shown["pos"] - first + LENGTH)[some].astype(np.int64))})


def _cut(batches):
    """row, n_removed, n_spans, kept of documents and their covered intervals."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for row, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "starts", "ends")), strict=True):
            mark = np.zeros(len(text) + 1, np.int32)
            np.add.at(mark, np.maximum(starts, 0), 1)
            np.add.at(mark, np.minimum(ends, len(text)), -1)
            gone = np.cumsum(mark[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((row, len(text) - len(kept), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), kept))
        row, removed, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and kept (null if nothing or all went).

    docs must be a stored table: its rows are numbered by their place. Removed is each UTF-8 byte covered by a string
    of LENGTH bytes that starts earlier too: in a smaller doc_id (null first, equal ids by place) or earlier in the
    document. Null and empty texts are 0 bytes; texts under LENGTH bytes stay whole.
    """
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    base = docs.select(place(docs).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), raw.alias("text"))
    facts = base.select("row", "doc", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    facts = stored(facts, "facts")
    firsts = stored(facts.groupBy("digest").agg(F.min_by("row", F.struct("doc", "row")).alias("row")).select("row"), "firsts")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deals = max(least, 2 * int(total) // (PLACES + 1) // DEALT)
    # Copies of a text take part, but what they have in common with the first one is known already.
    dealt = base.mapInArrow(_find(deals), "deal int, block binary").repartition(deals, "deal")
    met = stored(dealt.mapInArrow(_meet, "row long, pos int, h long").join(firsts, "row"), "met")
    open_ = met.where("h is not null")
    n_open = open_.count()
    places = open_.groupBy("row").agg(F.collect_list("pos").alias("places"), F.collect_list("h").alias("hashes"))
    deals = max(least, n_open // SHOWN)
    shown = base.join(places, "row").mapInArrow(_show(deals), "deal int, block binary").repartition(deals, "deal")
    settled = stored(shown.mapInArrow(_settle, "row long, start long, end long"), "settled")
    whole = met.where("h is null").select("row", (F.col("pos").cast("long") - SIDE).alias("start"), (F.col("pos").cast("long") + K + SIDE).alias("end"))
    covered = settled.unionByName(whole).groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    cut = base.select("row", "text").join(covered, "row").mapInArrow(_cut, "row long, n_removed long, n_spans long, kept binary")
    out = facts.join(firsts.withColumn("first", F.lit(True)), "row", "left").join(cut, "row", "left")
    copy = F.col("first").isNull() & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return out.select(
        "row",
        F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce(F.sha2("kept", 256), F.col("digest"))).alias("kept_sha256"),
        "kept",
    )
