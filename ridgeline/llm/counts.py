"""Token counts of documents without their ids.

A byte-level BPE file cuts a text into pre-tokens, and the tokens of a pre-token don't depend on what stands around it.
So each distinct pre-token is encoded once, for its number of tokens alone; a document's count is the sum over its
pre-tokens of frequency times that number. The join of the two is split by frequency: the commonest pre-tokens are a
table of bounded size that goes to every task, where they are summed as documents are read; the others, each in few
documents, are joined by a shuffle. So no pre-token gathers many rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import cache
from itertools import repeat
from operator import mul

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.llm._common import stored

#: Pre-tokens in the table of common ones at most, and their characters at most; distinct ones that a task holds.
COMMON, WIDEST, HELD = 1 << 18, 64, 500_000
#: Steps of the logarithm by which pre-tokens are graded for the table.
GRADES = 8
#: Fixed value: the split of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _ranges(name: str, top: int) -> str:
    """The characters up to `top` that the library has in a class of its patterns, as ranges for the module re."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(chr(c) for c in range(top + 1) if not 0xD800 <= c < 0xE000)
    points = sorted(ord(c) for part, _ in Split(Regex(name), "removed", invert=True).pre_tokenize_str(every) for c in part)
    starts = [c for k, c in enumerate(points) if not k or points[k - 1] != c - 1]
    ends = [c for k, c in enumerate(points) if k + 1 == len(points) or points[k + 1] != c + 1]
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in zip(starts, ends, strict=True))


def pre_token_patterns(tokenizer_path: str) -> tuple[str, str, str]:
    """Patterns of the pre-tokens of a byte-level BPE file, for texts within the basic plane (which Python searches by
    table) and for all texts, and of its added tokens (empty, if it has none). Files of another kind are refused, as
    their tokens may depend on what stands around a pre-token."""
    with open(tokenizer_path, encoding="utf-8") as f:
        file = json.load(f)
    cut, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not file.get("normalizer")
    added = file.get("added_tokens", [])
    if not plain or model.get("type") != "BPE" or model.get("dropout") or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{tokenizer_path} is no plain byte-level BPE file")
    out = []
    for top in (0xFFFF, 0x10FFFF):
        letter, number, space = (_ranges(name, top) for name in (r"\p{L}", r"\p{N}", r"\s"))
        out.append(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))
    return *out, "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))


def _splitter(narrow: str, wide: str, added: str):
    """A function from a text to its pre-tokens and its number of added tokens."""
    find, find_wide, outside = re.compile(narrow).findall, re.compile(wide).findall, re.compile("[\U00010000-\U0010FFFF]").search
    special = re.compile(added) if added else None

    def split(text: str) -> tuple[list[str], int]:
        parts = special.split(text) if special else [text]
        if len(parts) == 1:
            return (find_wide if outside(text) else find)(text), 0
        return [w for part in parts for w in (find_wide if outside(part) else find)(part)], len(parts) - 1

    return split


def pre_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The distinct pre-tokens of all texts: piece, seen (how often), n_tokens. Stored, each encoded once.

    tokenizer_path is read by driver and executors: a file at the same place on every machine.
    """
    patterns = pre_token_patterns(tokenizer_path)

    def count(batches):
        import pyarrow as pa

        split, seen = _splitter(*patterns), Counter()

        def rows():
            return pa.record_batch({"piece": pa.array(list(seen), pa.string()), "seen": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for text in batch.column("text"):
                seen.update(split(text.as_py() or "")[0])
                if len(seen) > HELD:
                    yield rows()
                    seen.clear()
        yield rows()

    def encode(batches):
        import os

        import pyarrow as pa
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bare = Tokenizer(Tokenizer.from_file(tokenizer_path).model)
        bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)  # the texts are pre-tokens already
        for batch in batches:
            found = bare.encode_batch_fast(batch.column("piece").to_pylist(), add_special_tokens=False)
            yield pa.record_batch({"piece": batch.column("piece"), "seen": batch.column("seen"), "n_tokens": pa.array([len(e) for e in found], pa.int64())})

    each = docs.select("text").mapInArrow(count, "piece string, seen long")
    return stored(each.groupBy("piece").agg(F.sum("seen").alias("seen")).mapInArrow(encode, "piece string, seen long, n_tokens long"), "pre_tokens")


def _common(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The common pre-tokens, COMMON at most, and all others. Grades of the logarithm of `seen` are counted, and the
    highest ones are taken as long as they fit: nothing is sorted."""
    grade = F.when(F.length("piece") <= WIDEST, F.floor(GRADES * F.log2("seen")).cast("int")).otherwise(-1)
    least, room = 1 << 30, COMMON
    for row in pieces.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect():  # 64 * GRADES rows at most
        if row["grade"] < 0 or row["count"] > room:
            break
        least, room = row["grade"], room - row["count"]
    return pieces.where(grade >= least), pieces.where(grade < least)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row, as the library's encoding has them
    without added special tokens, truncation or padding; the strings of added tokens in a text are those tokens.

    A null text is an empty one: 0 bytes, 0 tokens. Equal rows get equal rows; ids may be null or repeated; other columns
    are not read. An empty table gives an empty one. One task holds one text of less than 2 GiB at a time.
    """
    spark: SparkSession = docs.sparkSession
    patterns = pre_token_patterns(tokenizer_path)
    pieces = pre_tokens(docs, tokenizer_path)
    common, rare = _common(pieces)
    known = spark.sparkContext.broadcast({r["piece"]: r["n_tokens"] for r in common.select("piece", "n_tokens").collect()})

    def add_up(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        split, look = _splitter(*patterns), known.value.get
        for batch in batches:
            texts, totals, left = batch.column("text"), [], []
            for text in texts:
                words, special = split(text.as_py() or "")
                freq = Counter(words)
                n = list(map(look, freq, repeat(0)))
                totals.append(special + sum(map(mul, n, freq.values())))
                left.append([{"piece": w, "times": freq[w]} for w, k in zip(freq, n, strict=True) if not k] if 0 in n else [])
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            kind = pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())]))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": sizes, "n_tokens": pa.array(totals, pa.int64()), "rest": pa.array(left, kind)})

    out = StructType().add(docs.schema["doc_id"])
    for f in StructType.fromDDL("n_bytes long, n_tokens long, rest array<struct<piece string, times long>>"):
        out.add(f)
    # Stored, so that a row keeps its number whichever executor reads it again.
    rows = stored(docs.select("doc_id", "text").mapInArrow(add_up, out).withColumn("row", F.monotonically_increasing_id()), "counted")
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.piece", "r.times")
    more = rest.join(rare.select("piece", F.col("n_tokens").alias("each")), "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
    n = F.col("n_tokens") + F.coalesce("more", F.lit(0))
    return rows.drop("rest").join(more, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
