"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Matches of the fixed patterns are the seeds. The words to the left of seeds are lexical patterns; whatever follows a
pattern anywhere, of any shape, is its instance: a token, or some tokens with digits in a row. Scores spread over the
pattern-instance graph in rounds: an instance is as sure as its best pattern, a pattern as sure as the share of sure
instances of one kind among all it extracts. What follows sure patterns is a new span of that kind, unless its first
token mostly stands elsewhere, as common words do. Everything is DataFrame operations. Texts are cut into blocks of
tokens where they stand; only what follows a pattern with enough seeds is shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm._common import GAP, SPACE, place, stored

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; seeds that a pattern needs; least score of a pattern that extracts; code points of context kept.
ROUNDS, SEEDS, SURE, CONTEXT = 3, 5, 0.8, 64
#: Least share of seeds among a pattern's instances; least share of a first token's occurrences that sure patterns extract.
SEEDED, OWN = 0.1, 0.5
#: Tokens with digits in a row that are one instance at most; tokens in a block; rows of a table that is sent to all tasks.
GROUPS, BLOCK, SENT = 4, 64, 1 << 16
#: Patterns whose last words are looked for in whole texts before these are cut into tokens.
LISTED = 1 << 12

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+\\x02-]"
_NOT_SPACE = r"[^\x20\x09-\x0D]"


def _masked_email(text: Column) -> Column:
    """Dots that no label follows become U+0002, so that a domain is one run of characters."""
    return F.regexp_replace(F.translate(text, "\x02", "\x01"), r"\.(?![A-Za-z0-9-])", "\x02")


def _masked_card(text: Column) -> Column:
    """Separators that don't stand between two digits become U+0001, so that a card is one run of characters."""
    return F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "\x01")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    digits = F.reverse(_digits(found))
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


#: kind: column it is searched in, a quick test of the text, pattern, test of a match. The patterns find the leftmost
#: non-overlapping matches in time linear in the text: a run is only tried from its start or the last match's end.
SEARCH = {
    "email": ("dotted", lambda t: F.contains(t, F.lit("@")), rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++", lambda m: F.lit(True)),
    "ip": ("text", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: F.rlike(m, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))),
    "card": ("joined", lambda t: F.rlike(t, F.lit(r"[0-9][0-9\x20-]{14}")), r"[0-9][0-9\x20-]++", lambda m: F.when(_between(F.length(_digits(m)), 16, 19), _luhn(m)).otherwise(False)),
    "phone": ("text", lambda t: F.contains(t, F.lit("+")), r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _between(F.length(_digits(m)), 8, 15)),
}


def _context(gap: Column) -> Column:
    """The last two words before a match, lower-cased; null if the gap has none."""
    words = F.regexp_extract(F.lower(gap), rf"((?:{_NOT_SPACE}+{GAP})?{_NOT_SPACE}+)[\x20\x09-\x0D]*$", 1)
    return F.nullif(F.regexp_replace(words, GAP, " "), F.lit(""))


def _item(kind: str):
    def item(match: Column, k: Column) -> Column:
        gap = F.get(f"g_{kind}", k)
        return F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(gap).alias("gap"), F.length(match).alias("size"), match.alias("match"), _context(F.right(gap, F.lit(CONTEXT))).alias("context"))

    return item


def _found(docs: DataFrame) -> DataFrame:
    """Raw matches of every kind: row, doc_id, kind (null for a text without any), k, gap, size, match, context."""
    df = docs.withColumn("dotted", F.when(SEARCH["email"][1](F.col("text")), _masked_email(F.col("text"))))
    df = df.withColumn("joined", F.when(SEARCH["card"][1](F.col("text")), _masked_card(F.col("text"))))
    parts = []
    for kind, (where, test, pattern, _) in SEARCH.items():
        on = test(F.col("text"))
        df = df.withColumn(f"m_{kind}", F.when(on, F.regexp_extract_all(where, F.lit(pattern), 0)))
        df = df.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split(where, pattern)))
        parts.append(F.coalesce(F.transform(f"m_{kind}", _item(kind)), F.array().cast("array<struct<kind:string,k:int,gap:int,size:int,match:string,context:string>>")))
    return df.select("row", "doc_id", F.explode_outer(F.concat(*parts)).alias("f")).select("row", "doc_id", "f.*")


def _fixed(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, match, context: fixed matches that hold. A document without any has one row with
    kind null."""
    at = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(at)
    df = _found(docs).withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    holds = F.lit(True)
    for kind, (*_, test) in SEARCH.items():
        holds = F.when(F.col("kind") == kind, test(F.col("match"))).otherwise(holds)
    return df.select("row", "doc_id", F.when(holds, F.col("kind")).alias("kind"), "start", "end", "match", "context")


def _contexts(context: Column) -> Column:
    """The patterns of a place: the last two words before it, and the last one."""
    return F.array_distinct(F.array(context, F.regexp_extract(context, r"([^\x20]+)$", 1)))


def _near(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """df joined with a stored table of keys, which is sent to all tasks if it has few rows and characters."""
    size = keys.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length(on)), F.lit(0)).alias("characters")).first()
    return df.join(F.broadcast(keys) if size["rows"] <= SENT and size["characters"] <= CONTEXT * SENT else keys, on)


def _tokens(docs: DataFrame, places: bool) -> DataFrame:
    """row, context, first of every token of every text and each of its two patterns (the two words before it, and the last
    of them); with places also start and ahead, the token with the next GROUPS - 1 ones. Pieces are tokens with the
    white space before them; a block of pieces knows what is before it, so places are summed within blocks only."""
    pieces = F.regexp_extract_all(F.rtrim("text", F.lit(SPACE)), F.lit(rf"[\x20\x09-\x0D]*+{_NOT_SPACE}++"), F.lit(0))
    df = docs.select("row", pieces.alias("pieces"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    running = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("pieces"), F.lit(1)), F.lit(BLOCK)), lambda b: b <= F.size("pieces"))
    if places:
        df = df.withColumn("bases", running(F.transform(starts, lambda b: total(F.slice("pieces", b, F.lit(BLOCK))))))
    block = lambda b: F.struct(
        *[F.get("bases", F.floor((b - 1) / BLOCK).cast("int")).alias("base")] * places,
        F.slice("pieces", F.greatest(b - 2, F.lit(1)), F.least(b - 1, F.lit(2))).alias("before"),
        F.slice("pieces", b, F.lit(BLOCK)).alias("here"),
        F.slice("pieces", b + BLOCK, F.lit(GROUPS - 1)).alias("after"),
    )
    df = df.select("row", F.explode(F.transform(starts, block)).alias("b")).select("row", "b.*")
    none = F.array_repeat(F.lit(None).cast("string"), 2 - F.size("before"))
    df = df.withColumn("every", F.concat(none, "before", "here", "after")).withColumn("n", F.size("here"))
    # What is before and after each token stands beside it in arrays that are moved by one, so no function is called for each.
    columns = [F.slice("every", F.lit(1 + k), F.col("n")).alias(f"p{k}") for k in range(2 + (GROUPS if places else 1))]
    if places:
        columns += [F.slice(running(F.transform("here", F.length)), F.lit(1), F.col("n")).alias("from"), F.array_repeat("base", F.col("n")).alias("base")]
    names = [f"p{k}" for k in range(2 + (GROUPS if places else 1))] + ["from", "base"] * places
    df = df.select("row", *columns).select("row", F.explode(F.arrays_zip(*names)).alias("t")).select("row", "t.*")
    bare = lambda c: F.ltrim(c, F.lit(SPACE))
    last = F.lower(bare(F.col("p1")))
    two = F.concat(F.lower(bare(F.col("p0"))), F.lit(" "), last)
    cut = lambda c: F.substring(c, -CONTEXT, CONTEXT)
    out = [F.explode(F.array(cut(two), cut(last))).alias("context"), bare(F.col("p2")).alias("first")]
    if places:
        start = F.col("base") + F.col("from") + F.length("p2") - F.length(bare(F.col("p2")))
        out += [start.alias("start"), F.concat_ws("", *[f"p{k}" for k in range(2, 2 + GROUPS)]).alias("ahead")]
    return df.select("row", *out).where("context is not null")


def _with_pattern(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """docs without texts that can have none of the patterns, a stored table: a text with a pattern has its last word. Words
    are compared whole; where a pattern's word may be cut, texts with a word as long stay too. Many patterns leave docs as
    they are."""
    word = F.regexp_extract("context", r"([^\x20]+)$", 1)
    size = patterns.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.length(word)), F.lit(0)).alias("longest")).first()
    if size["rows"] > LISTED:
        return docs
    listed = patterns.agg(F.collect_set(word).alias("words"))
    has = F.arrays_overlap(F.split(F.lower("text"), GAP), F.col("_words"))
    if size["longest"] >= CONTEXT:
        has = has | F.rlike(F.lower("text"), F.lit(rf"{_NOT_SPACE}{{{CONTEXT}}}"))
    return docs.withColumn("_words", listed.scalar()).where(has).drop("_words")


def _candidates(tokens: DataFrame, patterns: DataFrame) -> DataFrame:
    """row, start, end, context, match, first of what follows patterns: tokens with digits in a row, or else one token, both
    without the marks at their end. What has neither letter nor digit is left out."""
    near = _near(tokens, patterns, "context").withColumn("ahead", F.ltrim("ahead", F.lit(SPACE)))
    number = rf"{_NOT_SPACE}*[0-9]{_NOT_SPACE}*"
    match = F.regexp_extract("ahead", rf"^(?:{number}(?:\x20{number}){{0,{GROUPS - 1}}}|{_NOT_SPACE}+)", 0)
    df = near.withColumn("match", F.regexp_replace(match, r"[.,;:!?]+$", "")).where(F.rlike("match", F.lit(r"[\p{L}\p{N}]")))
    return df.select("row", "start", (F.col("start") + F.length("match")).alias("end"), "context", "match", "first")


def _apart(candidates: DataFrame, fixed: DataFrame) -> DataFrame:
    """Candidates that meet no fixed span of their document."""
    spans = fixed.where("kind is not null").select("row", "start", "end", F.lit(True).alias("fixed"))
    both = candidates.withColumn("fixed", F.lit(False)).unionByName(spans, allowMissingColumns=True)
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("reached", F.max(F.when(F.col("fixed"), F.col("end"))).over(before)).withColumn("next", F.min(F.when(F.col("fixed"), F.col("start"))).over(after))
    meets = F.coalesce(F.col("reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return both.where(~F.col("fixed") & ~meets).select(*candidates.columns)


def seeded_patterns(fixed: DataFrame, tokens: DataFrame, seeds: int = SEEDS, share: float = SEEDED) -> DataFrame:
    """context of the patterns that `seeds` different seeds of one kind follow and that may have `share` of seeds among
    their instances: the estimate of their first tokens must not be twice what allows it."""
    edges = fixed.where("kind is not null and context is not null").select(F.explode(_contexts(F.col("context"))).alias("context"), "match", "kind").distinct()
    counts = edges.groupBy("context", "kind").count().groupBy("context").agg(F.max("count").alias("most")).where(F.col("most") >= seeds)
    counts = stored(counts, "seeded")
    wide = _near(tokens.select("context", "first"), counts, "context").groupBy("context", "most").agg(F.approx_count_distinct("first", 0.02).alias("n"))
    return stored(counts.join(wide.where(F.col("n") * share > 2 * F.col("most")), "context", "left_anti").select("context"), "contexts")


def sure_patterns(fixed: DataFrame, candidates: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, sure: float = SURE, share: float = SEEDED) -> DataFrame:
    """context, found_kind, score of the patterns that extract.

    A pattern is a context of one or two words. A seed's instance has score 1 for its kind; others start at 0. Each
    round: score of a pattern = sum of its instances' scores / (instances + 1), if `seeds` of them are seeds, and these
    are `share` of all; score of an instance = that of its best pattern.
    """
    seen = fixed.where("kind is not null and context is not null").select(F.explode(_contexts(F.col("context"))).alias("context"), "match", F.col("kind").alias("seed"))
    edges = seen.unionByName(candidates.select("context", "match", F.lit(None).cast("string").alias("seed")))
    edges = edges.groupBy("context", "match").agg(F.min("seed").alias("seed"))
    # Patterns without enough seeds never count; of the others, the graph is kept.
    counts = edges.groupBy("context").agg(F.count("*").alias("instances"), *[F.count(F.when(F.col("seed") == k, 1)).alias(k) for k in KINDS])
    most = F.greatest(*[F.col(k) for k in KINDS])
    enough = (most >= seeds) & (most >= share * F.col("instances"))
    # A pattern whose seeds of one kind and unseen instances together can't be sure is dropped for good.
    reach = F.greatest(*[(F.col("instances") - sum(F.col(o) for o in KINDS if o != k)) / (F.col("instances") + 1) for k in KINDS])
    counts = stored(counts.where(enough & (reach >= sure)), "patterns")
    graph = stored(edges.join(counts, "context").select("context", "match", "seed", "instances"), "graph")
    score = graph.select("match", F.col("seed").alias("found_kind"), F.when(F.col("seed").isNotNull(), 1.0).alias("score")).where("found_kind is not null").distinct()
    for n in range(rounds):
        known = graph.join(score, "match").groupBy("context", "found_kind").agg(F.sum("score").alias("mass"), F.count(F.when(F.col("seed") == F.col("found_kind"), 1)).alias("seeds"), F.max("instances").alias("instances"))
        patterns = known.where(F.col("seeds") >= seeds).select("context", "found_kind", (F.col("mass") / (F.col("instances") + 1)).alias("score"))
        patterns = stored(patterns, "scores")
        if n + 1 < rounds:
            spread = graph.where("seed is null").join(patterns, "context").select("match", "found_kind", "score")
            fixed = graph.where("seed is not null").select("match", F.col("seed").alias("found_kind"), F.lit(1.0).alias("score"))
            score = spread.unionByName(fixed).groupBy("match", "found_kind").agg(F.max("score").alias("score"))
    return patterns.where(F.col("score") >= sure)


def spans_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All spans: row, doc_id, kind, start, end (code points, end exclusive), base (found by a fixed pattern).

    docs must be a stored table: its rows are numbered by their place. A text without spans (null and empty ones too)
    has one row with kind null, so no document is lost; repeated rows and null ids are documents like others.
    """
    narrow = docs.select(place(docs).alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = stored(_fixed(narrow), "spans")
    seeded = seeded_patterns(spans, _tokens(narrow, places=False))
    near = stored(_apart(_candidates(_tokens(_with_pattern(narrow, seeded), places=True), seeded), spans), "candidates")
    patterns = stored(sure_patterns(spans, near), "sure")
    best = F.max_by("found_kind", F.struct("score", "found_kind"))
    found = _near(near, patterns, "context").groupBy("row", "start", "end", "first").agg(best.alias("kind"))
    found = stored(found, "found")
    extracted = stored(found.groupBy("first").agg(F.count("*").alias("extracted")), "firsts")
    words = narrow.select(F.explode(F.split("text", GAP)).alias("first"))
    own = _near(words, extracted, "first").groupBy("first", "extracted").agg(F.count("*").alias("n")).where(F.col("extracted") >= OWN * F.col("n"))
    found = found.join(own.select("first"), "first", "left_semi")
    ids = spans.select("row", "doc_id").distinct()
    found = found.join(ids, "row").select("row", "doc_id", "kind", "start", "end", F.lit(False).alias("base"))
    return spans.select("row", "doc_id", "kind", "start", "end", F.lit(True).alias("base")).unionByName(found)


def report(docs: DataFrame, **columns) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), base_sha256, spans."""
    spans = spans_of(docs, **columns)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.when(F.col("kind").isNotNull(), F.struct(order.alias("o"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("kind").alias("kind")))
    listed = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    counts = [F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in KINDS]
    out = spans.groupBy("row", "doc_id").agg(*counts, F.collect_list(F.when(F.col("base"), item)).alias("fixed"), F.collect_list(item).alias("every"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("fixed")), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of their text replaced by its kind in angle brackets; spans that overlap become one."""
    spans = spans_of(docs, doc_id, text).where("kind is not null")
    at = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.max("end").over(at)).withColumn("new", (F.coalesce(F.col("reached"), F.lit(0)) <= F.col("start")).cast("int"))
    spans = spans.withColumn("run", F.sum("new").over(Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("row", "run").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    cuts = runs.groupBy(F.col("row").alias("_rl_row")).agg(F.sort_array(F.collect_list(F.struct("s", "e", "kind"))).alias("_rl_cuts"))
    numbered = docs.select(F.struct(*docs.columns).alias("d"), place(docs).alias("_rl_row"))
    joined = numbered.join(cuts, "_rl_row", "left")
    body, cut = F.col("d")[text], F.col("_rl_cuts")
    # Before each cut: what follows the one before it.
    piece = F.transform(cut, lambda c, i: F.concat(F.substring(body, (F.coalesce(F.get(cut, i - 1)["e"], F.lit(0)) + 1).cast("int"), (c["s"] - F.coalesce(F.get(cut, i - 1)["e"], F.lit(0))).cast("int")), F.lit("<"), c["kind"], F.lit(">")))
    rest = F.substring(body, (F.element_at(cut, -1)["e"] + 1).cast("int"), F.length(body))
    return joined.select("d.*", F.when(cut.isNotNull(), F.concat(F.array_join(piece, ""), rest)).otherwise(body).alias("_rl_text")).select(*[F.col("_rl_text").alias(c) if c == text else F.col(c) for c in docs.columns])
