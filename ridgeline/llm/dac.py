"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level l holds the l-th chunks of the ids that have one, and a
bitmap that says which of them go on at level l + 1; a rank directory counts the set bits before every 512th bit.
Id i is then read by one access per level: its place at the next level is the rank of its bit.

A file set is a Parquet table of segments in order (part, segment): the ids of whole documents, with the documents'
ids and ends, and one code as payload. Spark's committer writes it, so lost executors leave no half files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm._common import shared_dir

MAGIC = b"RLDAC1\0\0"
#: Bits of a rank block; tokens after which a segment is closed; pieces that an encoder remembers; texts encoded at once.
RANK_BITS, SEGMENT, REMEMBER, TEXTS = 512, 1 << 18, 1_000_000, 4000
#: Fixed value: the split of tokenizer files whose pieces end at blanks.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SEGMENT = "part int, segment int, n_tokens long, doc_ids array<long>, doc_ends array<long>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """The code of unsigned 32-bit ids."""
    out, rest = [], ids.astype(np.uint32)
    levels = 0
    while levels == 0 or len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-max(1, len(bits)) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
        padded[: len(bits)] = bits
        counts = np.bitwise_count(padded.reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
        out += [struct.pack("<QQ", len(rest), len(padded)), (rest & 255).astype(np.uint8).tobytes(), padded.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
        levels += 1
    return MAGIC + struct.pack("<Q", levels) + b"".join(out)


class Reader:
    """Reads single ids, ranges or all ids of a code."""

    def __init__(self, code: bytes):
        if code[:8] != MAGIC:
            raise ValueError("not a code of this format")
        (levels,), at, self.levels = struct.unpack_from("<Q", code, 8), 16, []
        for _ in range(levels):
            n, bitmap = struct.unpack_from("<QQ", code, at)
            chunks = np.frombuffer(code, np.uint8, n, at + 16)
            bits = np.frombuffer(code, np.uint8, bitmap, at + 16 + n)
            ranks = np.frombuffer(code, "<u4", bitmap * 8 // RANK_BITS, at + 16 + n + bitmap)
            self.levels.append((chunks, bits, ranks))
            at += 16 + n + bitmap + 4 * len(ranks)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, i: int) -> int:
        """Id i, by one access and one rank for each of its chunks."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for shift, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * shift)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = bits[block * (RANK_BITS // 8) : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        value, places = np.zeros(len(self), np.uint32), np.arange(len(self))
        for shift, (chunks, bits, _) in enumerate(self.levels):
            value[places] |= chunks.astype(np.uint32) << np.uint32(8 * shift)
            places = places[np.unpackbits(bits, bitorder="little")[: len(chunks)].astype(bool)]
        return value


def _ends_at_blanks(file: dict) -> bool:
    """Whether a tokenizer file is known never to join what a blank or line end separates, and to part a comma or full
    stop from an ASCII letter or digit before it: then texts may be cut there, and a piece be encoded once."""
    kinds = [n.get("type") for n in (file.get("normalizer") or {}).get("normalizers", [])]
    splits = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in file.get("added_tokens", []))
    split = splits[0] if splits else {}
    pattern = split.get("pattern", {}).get("Regex") if split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") else None
    return plain and file.get("post_processor") is None and set(kinds) <= {"NFC", "Replace", "Lowercase"} and pattern == PIECES


def _encoder(tokenizer_path: str):
    """A function from an Arrow column of texts to ids, lengths and dictionary numbers: ids of all distinct pieces in one
    array, their lengths, the piece numbers of all texts one after the other, and the offsets of texts in those."""
    import json
    import re

    import pyarrow as pa
    import pyarrow.compute as pc
    import tokenizers

    # A Python worker serves many tasks; what one has learnt stays with the library's module for the next.
    kept = tokenizers.__dict__.setdefault("_ridgeline_encoders", {})
    if tokenizer_path in kept:
        return kept[tokenizer_path]
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path)
    with open(tokenizer_path, encoding="utf-8") as f:
        by_piece = _ends_at_blanks(json.load(f))
    known: dict[str, bytes] = {}
    bare = re.compile(r"[A-Za-z]+")

    def learn(pieces: list[str]) -> None:
        """Codes of new pieces; case doesn't matter to pieces of ASCII letters, as the tokenizer lower-cases them."""
        lowers = lowercases and {p: p.lower() for p in pieces if bare.fullmatch(p)} or {}
        new = list({lowers.get(p, p) for p in pieces} - known.keys())
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            for p, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, "<u4").tobytes()
        for p, low in lowers.items():
            known[p] = known[low]

    lowercases = '"Lowercase"' in open(tokenizer_path, encoding="utf-8").read().partition('"model"')[0]

    def encode(texts):
        nonlocal known
        if by_piece:
            cut = pc.replace_substring_regex(texts, r"([A-Za-z0-9])([.,])( |\n|$)", r"\1 \2\3")
            words = pc.split_pattern(pc.replace_substring(cut, "\n", " "), " ")
        else:
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        missing = [p for p in distinct if p not in known]
        if len(known) + len(missing) > REMEMBER:
            known, missing = {}, distinct
        learn(missing)
        codes = [known[p] for p in distinct]
        lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        offsets = words.offsets.to_numpy().astype(np.int64)
        return np.frombuffer(b"".join(codes), "<u4"), lengths, coded.indices.to_numpy(), offsets - offsets[0]

    kept[tokenizer_path] = encode
    return encode


def _ids(encode, texts, end_id: int):
    """Ids of texts, each with the end id, and where each text ends."""
    pool, lengths, numbers, offsets = encode(texts)
    pool, lengths = np.append(pool, np.uint32(end_id)), np.append(lengths, 1)
    numbers = np.insert(numbers.astype(np.int64), offsets[1:], len(lengths) - 1)
    starts, sizes = (np.cumsum(lengths) - lengths)[numbers], lengths[numbers]
    until = np.cumsum(sizes)
    ids = pool[np.repeat(starts - (until - sizes), sizes) + np.arange(until[-1])]
    return ids, until[offsets[1:] + np.arange(len(texts))]


def _segments(tokenizer_path: str, end_id: int):
    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        doc_ids, ends, codes, total, segment = [], [], [], 0, 0

        def close():
            columns = {"part": [part], "segment": [segment], "n_tokens": [total], "doc_ids": [doc_ids], "doc_ends": [ends], "payload": [pack(np.concatenate(codes))]}
            kinds = {"part": pa.int32(), "segment": pa.int32(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "doc_ends": pa.list_(pa.int64()), "payload": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in kinds.items()], names=list(kinds))

        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                some = batch.slice(at, TEXTS)
                ids, until = _ids(encode, some.column("text"), end_id)
                names, first, done = some.column("doc_id").to_pylist(), 0, 0
                while first < len(names):
                    # The document that fills the segment is its last one.
                    last = min(int(np.searchsorted(until, done + SEGMENT - total)) + 1, len(names))
                    doc_ids += names[first:last]
                    ends += (until[first:last] - done + total).tolist()
                    codes.append(ids[done : until[last - 1]])
                    total, done, first = ends[-1], int(until[last - 1]), last
                    if total >= SEGMENT:
                        yield close()
                        doc_ids, ends, codes, total, segment = [], [], [], 0, segment + 1
        if doc_ids:
            yield close()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes docs and writes them in ascending order of id (null first, equal ids by text). A null text is empty; an
    empty one has the end id alone. Strings of the tokenizer's added tokens in a text become those tokens, as in the
    library. Other columns are ignored. An empty table makes an empty file set."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_segments(tokenizer_path, end_id), _SEGMENT).write.parquet(path)


def _documents(batches):
    import pyarrow as pa

    for batch in batches:
        for payload, doc_ids, doc_ends, before in zip(*(batch.column(c).to_pylist() for c in ("payload", "doc_ids", "doc_ends", "before")), strict=True):
            reader = Reader(payload)
            ids, starts = reader.all().astype("<u4"), [0, *doc_ends[:-1]]
            out = {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "start": pa.array([before + a for a in starts], pa.int64()),
                "n_tokens": pa.array([b - a for a, b in zip(starts, doc_ends, strict=True)], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b].data) for a, b in zip(starts, doc_ends, strict=True)], pa.int64()),
                "middle_id": pa.array([reader.get((a + b) // 2) for a, b in zip(starts, doc_ends, strict=True)], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(out)


def _singles(batches):
    import pyarrow as pa

    for batch in batches:
        for payload, before, places in zip(*(batch.column(c).to_pylist() for c in ("payload", "before", "places")), strict=True):
            reader = Reader(payload)
            yield pa.RecordBatch.from_pydict({"place": pa.array(places, pa.int64()), "id": pa.array([reader.get(i - before) for i in places], pa.int64())})


def token_at(spark, path: str, places: DataFrame) -> DataFrame:
    """place, id: the ids at single places of a file set, each by one access for a chunk; places is a table with the
    column place. Only segments with a place in them are read; null places and those beyond the end give no row."""
    found = segments(spark, path)
    span = F.sequence(F.floor(F.col("before") / SEGMENT), F.floor((F.col("before") + F.col("n_tokens") - 1) / SEGMENT))
    lists = found.where("n_tokens > 0").select("part", "segment", "before", (F.col("before") + F.col("n_tokens")).alias("after"), F.explode(span).alias("cell"))
    asked = places.select(F.col("place").cast("long").alias("place"), F.floor(F.col("place") / SEGMENT).alias("cell")).distinct()
    met = asked.join(lists, "cell").where("place >= before and place < after").groupBy("part", "segment").agg(F.collect_list("place").alias("places"))
    return found.join(met, ["part", "segment"]).select("before", "payload", "places").mapInArrow(_singles, "place long, id long")


def segments(spark, path: str) -> DataFrame:
    """The segments of a file set, each with the number of ids before it."""
    found = spark.read.parquet(path)
    # One sum for each written part goes through the driver; within a part, a window adds up its segments.
    sums, before, offsets = {r["part"]: r["n"] for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}, 0, []
    for part in sorted(sums):
        offsets.append((part, before))
        before += sums[part]
    offsets = spark.createDataFrame(offsets, "part int, part_before long")
    by = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    within = found.select("part", "segment", F.coalesce(F.sum("n_tokens").over(by), F.lit(0)).alias("within"))
    places = within.join(F.broadcast(offsets), "part").select("part", "segment", (F.col("within") + F.col("part_before")).alias("before"))
    return found.join(places, ["part", "segment"])


def documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and middle_id (the id in the middle, read singly) of every document of a file
    set, from its files."""
    rows = segments(spark, path).select("before", "doc_ids", "doc_ends", "payload")
    return rows.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long, middle_id long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, **columns) -> DataFrame:
    """Writes docs to a new file set in the shared folder and reads it back."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/dac-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id, **columns)
    return documents(docs.sparkSession, path)
