"""Byte-level BPE as Spark expressions.

The split pattern cuts texts into words. A higher-order function folds ranked merges over the bytes of a word: its state
is the array of pieces and, for each, the rank of the merge with its right neighbour; a step takes the leftmost least
rank, looks up the two merges that the new piece allows, and does nothing once no merge is left. A word that is a piece
itself is that piece, as in the library. The most frequent distinct words are folded once, into a table of bounded
size; the others by the same fold where they stand. Decoding looks ids up in the literal map of pieces and concatenates
them.

A word of LONG bytes or more is cut first between bytes that no piece of the vocabulary spans. In parts that are still
as long, a step merges every place of the least rank, from left to right, unless one of these merges would allow another
of lesser rank; then it merges the leftmost only. So the time doesn't grow with the square of the length.

Literal maps are arrays of small buckets by hash, as Spark searches a map value from its start.
"""

from __future__ import annotations

import base64
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm._common import stored

#: Words in the table of frequent ones at most, and their characters at most; bits of an id in a key of two.
FREQUENT, WIDEST, BITS = 1 << 19, 64, 24
#: Bytes from which on a word is cut and a step looks for all places of a rank (the ids are the same either way), and
#: pieces in a stretch that is searched for a rank at once.
LONG, STRETCH = 512, 128
#: Steps of the logarithm by which words are graded for the table.
GRADES = 8


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Pieces and ranks of a rank file, read once by the driver: a vocabulary, not data."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


@cache
def _library_class(name: str) -> frozenset[int]:
    """Code points that the library has in a class of its patterns."""
    import tiktoken

    library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return frozenset(ord(c) for k in range(0, len(every), 1 << 16) for c in library.decode(library.encode_ordinary(every[k : k + (1 << 16)])))


def _ranges(points: set[int]) -> str:
    out, points = [], sorted(points)
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


@cache
def _java_classes(names: tuple[str, ...]) -> dict[str, str]:
    """Each class as Java has to be told it: its own one, with what the library's newer Unicode tables add or remove."""
    spark = SparkSession.getActiveSession()
    points = spark.range(0x110000).where("id not between 55296 and 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    found = points.agg(*[F.collect_list(F.when(F.rlike("c", F.lit(f"(?U)^{n}\\z")), F.col("id").cast("int"))) for n in names]).first()
    out = {}
    for java, name in zip(map(set, found), names, strict=True):
        library = _library_class(name)
        more, less = library - java, java - library
        text = f"[{name}&&[^{_ranges(less)}]]" if less else name
        # The quick test of the lowest one keeps ordinary characters off the long list.
        out[name] = text + (rf"[\x{{{min(more):X}}}-\x{{10FFFF}}&&[{_ranges(more)}]]" if more else "")
    return out


def java_pattern(pattern: str) -> str:
    r"""The split pattern for Java: white space in the Unicode sense, \p{L} and \p{N} as the library knows them."""
    classes = _java_classes((r"\p{L}", r"\p{N}"))
    out, depth, k = [], 0, 0
    while k < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, k)), None)
        if name:
            out.append(classes[name] if depth else f"[{classes[name]}]")
            k += len(name)
            continue
        if pattern[k] == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        depth += (pattern[k] == "[") - (pattern[k] == "]")
        out.append(pattern[k])
        k += 1
    return "(?U)" + "".join(out)


# Every table is a column that is referred to once, so that the optimizer puts the literal in its place; a column that is
# referred to twice would be copied for every row, and a literal in several places would be sent to the tasks as often.


def _bucketed(df: DataFrame, key: str, value: str, buckets: int) -> DataFrame:
    """A stored table of one row with one array: at each hash of a key, the small map of the keys that fall there. All
    references to it read the same file, so Spark makes the array once for all columns of a query."""
    full = df.groupBy(_bucket(key, buckets).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value)))).alias("e"))
    every = df.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("b"))
    pairs = every.join(full, "b", "left").agg(F.collect_list(F.struct("b", F.map_entries("e").alias("e"))).alias("s"))
    return stored(pairs.select(F.transform(F.sort_array("s"), lambda x: F.map_from_entries(x["e"])).alias("t")), "map")


def _bucket(key, buckets: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def _look(table: tuple[Column, int], key: Column) -> Column:
    return F.try_element_at(F.get(table[0], _bucket(key, table[1])), key)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


class _Tables:
    """The literal maps of a vocabulary: piece to rank, pair of ids to the rank of their merge, byte to id, and the
    sequences of three bytes that are in a piece."""

    def __init__(self, spark: SparkSession, vocabulary: list[tuple[bytes, int]]):
        ranks = dict(vocabulary)
        if max(ranks.values()) >= 1 << BITS or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("ranks must be below 2^24, and every byte a piece")
        pairs = [(ranks[a] << BITS | ranks[b], r) for p, r in vocabulary for k in range(1, len(p)) if (a := p[:k]) in ranks and (b := p[k:]) in ranks]
        spans = sorted({int.from_bytes(p[k : k + 3]) for p, _ in vocabulary for k in range(len(p) - 2)})
        # Words are looked up as strings; a piece that is no text can't be a word.
        texts = [(p.decode(), r) for p, r in vocabulary if _is_text(p)]
        self.bytes = F.array(*[F.lit(ranks[bytes([b])]) for b in range(256)])
        self.maps = {
            "pairs": self._map(spark.createDataFrame(pairs or [(-1, 0)], "pair long, rank int"), len(pairs)),
            "spans": self._map(spark.createDataFrame([(x, 1) for x in spans] or [(-1, 0)], "span int, one int"), len(spans)),
            "pieces": self._map(spark.createDataFrame(texts, "piece string, rank int"), len(texts)),
        }

    @staticmethod
    def _map(df: DataFrame, n: int) -> tuple[DataFrame, int]:
        buckets = 1 << max(8, n.bit_length())
        return _bucketed(df, *df.columns, buckets), buckets

    def folded(self, df: DataFrame, with_ids) -> DataFrame:
        """df with a column for each table and with `ids`: with_ids' expression, a function of the fold. All places of the
        fold that look into a table share one variable, so that a task is sent each table once."""

        def bound(names: list[str], tables: dict[str, Column]) -> Column:
            if names:
                return _let(F.col(f"_{names[0]}"), lambda t: bound(names[1:], {**tables, names[0]: t}))
            look = lambda name, key: _look((tables[name], self.maps[name][1]), key)
            return with_ids(lambda word: self._fold(word, look))

        for name, (table, _) in self.maps.items():
            df = df.withColumn(f"_{name}", table.scalar())
        return df.withColumn("ids", bound(list(self.maps), {}))

    def _fold(self, word: Column, look) -> Column:
        """Ids of a word."""
        key = lambda a, b: F.shiftleft(a.cast("long"), BITS).bitwiseOR(b.cast("long"))
        merged = lambda a, b: look("pairs", key(a, b))

        def step(state: Column, i: Column) -> Column:
            """Merges piece i (from 1) with the next one."""
            p, r = state["p"], state["r"]
            new = F.get(r, i - 1)
            around = F.array(key(F.get(p, i - 2), new), key(new, F.get(p, i + 1)))
            found = F.transform(F.slice(around, F.when(i > 1, 1).otherwise(2), F.lit(2)), lambda k: look("pairs", k))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(new), F.slice(p, i + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), found, F.slice(r, i + 2, F.size(p))).alias("r"),
            )

        def places(p: Column, r: Column, i: Column, new: Column) -> Column:
            """Where a step merges all pairs of the least rank, which piece i (from 1) has first: r is searched in the
            stretches that have it. Places that follow each other overlap: every second one from the left is taken."""
            inside = F.filter(F.sequence(i - 1, F.size(r) - 1, F.lit(STRETCH)), lambda b: F.array_contains(F.slice(r, b + 1, F.lit(STRETCH)), new))
            hits = F.flatten(F.transform(inside, lambda b: F.filter(F.sequence(b, F.least(b + STRETCH, F.size(r)) - 1), lambda h: F.get(r, h) == new)))

            def apart(hits: Column) -> Column:
                first = F.filter(hits, lambda h: ~F.get(r, h - 1).eqNullSafe(new))
                last = F.filter(hits, lambda h: ~F.get(r, h + 1).eqNullSafe(new))
                return F.flatten(F.zip_with(first, last, lambda a, b: F.sequence(a, b, F.lit(2))))

            def described(at: Column, twin: Column) -> Column:
                """A place (from 0), the end of the one before, and the ranks of the new piece's merges on both sides."""
                return F.transform(
                    at,
                    lambda h, k: F.struct(
                        h.alias("at"),
                        F.coalesce(F.get(at, k - 1) + 2, F.lit(0)).alias("from"),
                        merged(F.get(p, h - 1), new).alias("left"),
                        merged(new, F.get(p, h + 2)).alias("right"),
                        F.when(F.get(at, k + 1) == h + 2, F.struct(twin.alias("rank"))).alias("next"),
                    ),
                )

            return _let(hits, lambda hits: _let(apart(hits), lambda at: _let(F.struct(merged(new, new).alias("twin")), lambda t: described(at, t["twin"]))))

        def sweep(state: Column, i: Column) -> Column:
            """Merges all places of the least rank, or the first one if a merge of lesser rank would follow."""

            def put(p: Column, r: Column, new: Column, found: Column) -> Column:
                rest = F.get(F.transform(F.slice(found, F.lit(-1), F.lit(1)), lambda x: x["at"] + 3), F.lit(0))
                after = lambda x: F.when(x["next"].isNotNull(), x["next"]["rank"]).otherwise(x["right"])
                pieces = lambda x: F.when(x["at"] == x["from"], F.array(new)).otherwise(F.concat(F.slice(p, x["from"] + 1, x["at"] - x["from"]), F.array(new)))
                ranks = lambda x: F.when(x["at"] == x["from"], F.array(after(x))).otherwise(F.concat(F.slice(r, x["from"] + 1, x["at"] - x["from"] - 1), F.array(x["left"], after(x))))
                return F.struct(
                    F.concat(F.flatten(F.transform(found, pieces)), F.slice(p, rest, F.size(p))).alias("p"),
                    F.concat(F.flatten(F.transform(found, ranks)), F.slice(r, rest, F.size(r))).alias("r"),
                )

            def all_or_first(p: Column, r: Column, new: Column) -> Column:
                lesser = lambda x: F.coalesce(F.least(x["left"], x["right"], x["next"]["rank"]) < new, F.lit(False))
                return _let(places(p, r, i, new), lambda found: F.when(F.exists(found, lesser), step(state, i)).otherwise(put(p, r, new, found)))

            return _let(state["p"], lambda p: _let(state["r"], lambda r: _let(F.get(r, i - 1), lambda new: all_or_first(p, r, new))))

        def ids(start: Column, one) -> Column:
            """Steps until no merge is left."""
            ranks = F.transform(start, lambda a, k: look("pairs", key(a, F.get(start, k + 1))))
            state = F.struct(start.alias("p"), ranks.alias("r"))
            return F.aggregate(F.slice(start, F.lit(2), F.size(start)), state, lambda s, _: _let(F.array_position(s["r"], F.array_min(s["r"])).cast("int"), lambda i: one(s, i)), lambda s: s["p"])

        def one_of_short(s: Column, i: Column) -> Column:
            return F.when(i > 0, step(s, i)).otherwise(s)

        def one_of_long(s: Column, i: Column) -> Column:
            # Without a merge left, the ranks are emptied, so that the steps that remain cost nothing.
            done = F.struct(s["p"].alias("p"), F.slice(s["r"], F.lit(1), F.lit(0)).alias("r"))
            return F.when(i.isNull(), done).when(F.size(s["r"]) < LONG, step(s, i)).otherwise(sweep(s, i))

        def cut(start: Column) -> Column:
            """Bytes in parts that no piece spans: two bytes are no piece, nor are they in one with a third byte."""
            spanned = lambda c, j: look("spans", F.shiftleft(F.get(c, j), 16) + F.shiftleft(F.get(c, j + 1), 8) + F.get(c, j + 2)).isNotNull()
            piece = lambda c, j: merged(F.get(self.bytes, F.get(c, j)), F.get(self.bytes, F.get(c, j + 1))).isNotNull()

            def parts(c: Column) -> Column:
                last = F.size(c) - 1
                ends = F.filter(F.sequence(F.lit(0), last - 1), lambda j: ~(piece(c, j) | spanned(c, j - 1) | spanned(c, j)))
                return _let(ends, lambda e: F.zip_with(F.concat(F.array(F.lit(-1)), e), F.concat(e, F.array(last)), lambda a, b: F.transform(F.slice(c, a + 2, b - a), lambda x: F.get(self.bytes, x))))

            return _let(start, parts)

        letters = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
        short = _let(F.transform(letters, lambda c: F.get(self.bytes, F.ascii(c))), lambda start: ids(start, one_of_short))
        long = F.flatten(F.transform(cut(F.transform(letters, F.ascii)), lambda part: ids(part, one_of_long)))
        whole = F.filter(F.array(look("pieces", word)), lambda x: x.isNotNull())
        return _let(whole, lambda whole: F.when(F.size(whole) > 0, whole).when(F.octet_length(word) < LONG, short).otherwise(long))


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def _split(pattern: str) -> Column:
    return F.regexp_extract_all("text", F.lit(java_pattern(pattern)), F.lit(0))


def frequent_words(texts: DataFrame, pattern: str, tables: _Tables, limit: int = FREQUENT) -> DataFrame:
    """word, ids of the most frequent distinct words: of all texts, it is counted how many have a word, and the words from
    the least count on that leaves at most `limit` are folded. Words of one text, and those of over WIDEST characters,
    aren't in it."""
    counts = texts.select(F.explode(F.array_distinct(_split(pattern))).alias("word")).groupBy("word").count()
    grade = F.floor(GRADES * F.log2("count")).cast("int")
    counts = stored(counts.where((F.col("count") > 1) & (F.length("word") <= WIDEST)).select("word", grade.alias("grade")), "counts")
    total, least = 0, None
    for r in counts.groupBy("grade").count().orderBy(F.desc("grade")).collect():  # some hundred rows
        total += r["count"]
        if total > limit:
            break
        least = r["grade"]
    top = counts.where(F.col("grade") >= least if least is not None else F.lit(False)).select("word")
    folded = tables.folded(top.repartition(texts.sparkSession.sparkContext.defaultParallelism * 2), lambda fold: fold(F.col("word")))
    return stored(folded.select("word", "ids"), "words")


def encode(docs: DataFrame, pattern: str, vocabulary: list[tuple[bytes, int]], doc_id: str = "doc_id", text: str = "text", limit: int = FREQUENT) -> DataFrame:
    """doc_id, ids of every document."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tables = _Tables(docs.sparkSession, vocabulary)
    words = frequent_words(texts, pattern, tables, limit)
    buckets = 1 << max(8, words.count().bit_length())
    split = texts.withColumn("w", _split(pattern)).withColumn("_known", _bucketed(words, "word", "ids", buckets).scalar())
    every = lambda fold: F.flatten(F.transform("w", lambda w: F.coalesce(_look((F.col("_known"), buckets), w), fold(w))))
    return tables.folded(split, every).select("doc_id", "ids")


def decode(ids: DataFrame, vocabulary: list[tuple[bytes, int]]) -> DataFrame:
    """Adds decoded (binary): the pieces of ids one after the other."""
    spark, last = ids.sparkSession, max(r for _, r in vocabulary)
    ranks = spark.createDataFrame(vocabulary, "piece binary, rank int")
    every = spark.range(0, last + 1, 1, 1).select(F.col("id").cast("int").alias("rank")).join(ranks, "rank", "left")
    pieces = every.agg(F.sort_array(F.collect_list(F.struct("rank", F.hex("piece").alias("p")))).alias("s")).select(F.transform("s", lambda x: x["p"]).alias("t"))
    joined = ids.withColumn("pieces", pieces.scalar())
    return joined.withColumn("decoded", F.unhex(F.array_join(F.transform("ids", lambda i: F.get(F.col("pieces"), i)), ""))).drop("pieces")


def round_trip(docs: DataFrame, pattern: str, vocabulary: list[tuple[bytes, int]], doc_id: str = "doc_id", text: str = "text", limit: int = FREQUENT) -> DataFrame:
    """Encodes and decodes every document: doc_id, n_tokens, ids_sha256 (decimal ids, comma-joined), decoded_sha256.

    A null text is empty and has no tokens. Repeated rows and null ids get a row each; an empty table gives none; other
    columns of docs don't matter. A run that the pattern doesn't split takes time with the lengths of the parts into which
    it can be cut, each times the different ranks in it.
    """
    return decode(encode(docs, pattern, vocabulary, doc_id, text, limit), vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
