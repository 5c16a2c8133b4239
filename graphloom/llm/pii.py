"""Personal data: fixed patterns, and bootstrapped contextual extraction of identifiers beyond them.

All of it is DataFrame functions. Matches are located by splitting a text at them: what stands between
matches, and their own lengths, give their places in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, settled

# Each kind's pattern, in an equal form that reads a text once (no start within a run that
# an earlier start has tried in vain; \G lets a match begin where the last one ended).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A character that every match of the kind has; texts without it are not searched.
_SIGNS = {"email": "@", "ip": ".", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words that may be identifiers: with an at-sign or five digits.
_TOKEN = r"(?<!\S)(?=[^\s@]*+@|(?:[^\s0-9]*+[0-9]){5})\S++"
LEARNED = "id"

#: A pattern is trusted from so many different instances, and so large a share of known ones among them.
SUPPORT, TRUST = 5, 0.8


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(text))
        return F.when(n.between(14, 19), F.call_function("luhn_check", _digits(text))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    return F.lit(True)


def _running(df: DataFrame, name: str, values: str, kind: str = "sum") -> DataFrame:
    """df with a column `name`: the sum, or the greatest, of an array of longs (0 or more) up to each place.

    Two levels of blocks, as an array that grows by one is copied: n values take n to the power 1.5 steps.
    """
    join = (lambda a, b: a + b) if kind == "sum" else F.greatest
    longs = lambda c: c.cast("array<long>")
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("long"))
    grow = lambda done, x: F.concat(done, F.array(join(last(done), x)))
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.col("_width"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_width", F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"))
    df = df.withColumn("_blocks", F.transform(starts, lambda s: F.aggregate(F.slice(values, s, F.col("_width")), longs(F.array()), grow)))
    df = df.withColumn("_tops", F.aggregate(F.transform("_blocks", last), longs(F.array(F.lit(0))), grow))
    whole = F.flatten(F.zip_with("_blocks", F.slice("_tops", 1, F.size("_blocks")), lambda block, top: F.transform(block, lambda x: join(x, top))))
    return df.withColumn(name, whole).drop("_width", "_blocks", "_tops")


def _located(df: DataFrame, name: str, text: str, matches: str, pattern: str) -> DataFrame:
    """df with a column `name`: the matches with their starts (which add up from what is split off before each, and
    the matches before it) and the text between the match before and this one."""
    df = df.withColumn("_gap", F.when(F.size(matches) > 0, F.slice(F.split(F.col(text), pattern, -1), 1, F.size(matches))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_steps", F.zip_with("_gap", matches, lambda a, b: (F.length(a) + F.length(b)).cast("long")))
    df = _running(df, "_ends", "_steps")
    each = F.arrays_zip(F.col(matches).alias("text"), F.col("_gap").alias("gap"), F.col("_ends").alias("end"))
    at = F.transform(each, lambda x: F.struct((x["end"] - F.length(x["text"])).alias("start"), x["text"].alias("text"), x["gap"].alias("gap")))
    return df.withColumn(name, at).drop("_gap", "_steps", "_ends")


def find_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column `_base`: array of (start, rank, kind, end), by start and then kind as listed."""
    found = docs
    for kind, pattern in PATTERNS.items():
        every = F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))
        if kind in _SIGNS:
            every = F.when(F.instr(F.col(text_col), _SIGNS[kind]) > 0, every)
        found = found.withColumn(f"_m_{kind}", F.coalesce(every, F.array().cast("array<string>")))

    def spans(rank: int, kind: str) -> Column:
        good = F.filter(f"_at_{kind}", lambda x: _valid(kind, x["text"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["text"])).alias("end")))

    for kind, pattern in PATTERNS.items():
        found = _located(found, f"_at_{kind}", text_col, f"_m_{kind}", pattern)
    base = F.array_sort(F.concat(*(spans(k, kind) for k, kind in enumerate(PATTERNS))))
    return found.withColumn("_base", base).drop(*(f"_{c}_{k}" for k in PATTERNS for c in ("m", "at")))


def _candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with `_tokens`: array of (start, end, instance, pattern, seed).

    instance is an identifier-like word (an at-sign, or five digits or more) without marks around it;
    pattern the word before it, in lower case, with runs of digits as 0 ("^" at the text's start); seed
    is whether a base span overlaps it. Words are whole, and so is the white space between them.
    """
    found = docs.withColumn("_m", F.coalesce(F.regexp_extract_all(text_col, F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>")))
    found = _located(found, "_at", text_col, "_m", _TOKEN)
    last_word = lambda t: F.substring_index(F.rtrim(F.translate(t, "\n\t\r\x0b\f", "     ")), " ", -1)

    def token(x: Column, k: Column) -> Column:
        core = F.regexp_extract(x["text"], r"[A-Za-z0-9@+](?:.*[A-Za-z0-9])?", 0)
        begin = x["start"] + F.instr(x["text"], core) - 1
        word = last_word(x["gap"])
        before = F.when(word != "", word).when(k > 0, F.get(F.col("_m"), k - 1)).otherwise("")
        pattern = F.lower(F.regexp_replace(before, "[0-9]+", "0"))
        return F.struct(begin.cast("long").alias("start"), (begin + F.length(core)).cast("long").alias("end"), core.alias("instance"), F.when(pattern == "", "^").otherwise(pattern).alias("pattern"))

    likely = lambda t: (F.length(t["instance"]) > 0) & (F.contains(t["instance"], F.lit("@")) | (F.length(_digits(t["instance"])) >= 5))
    found = found.withColumn("_t", F.filter(F.transform("_at", token), likely))
    # A word overlaps a base span if of the spans that start before its end one ends behind its start.
    event = lambda at, k, end: F.struct(at.alias("at"), k.alias("k"), end.alias("end"))
    ends = F.transform("_t", lambda t, k: event(t["end"], k, F.lit(0).cast("long")))
    events = F.array_sort(F.concat(ends, F.transform("_base", lambda b: event(b["start"], F.lit(2**31 - 1), b["end"].cast("long")))))
    found = found.withColumn("_events", events).withColumn("_reach", F.transform("_events", lambda x: x["end"]))
    found = _running(found, "_reach", "_reach", "greatest")
    # Words are in order, and so are their ends.
    found = found.withColumn("_reach", F.transform(F.filter(F.arrays_zip("_events", "_reach"), lambda x: x["_events"]["k"] < 2**31 - 1), lambda x: x["_reach"]))
    tokens = F.zip_with("_t", "_reach", lambda t, reach: F.struct(*(t[c].alias(c) for c in ("start", "end", "instance", "pattern")), (t["start"] < reach).alias("seed")))
    return found.withColumn("_tokens", tokens).drop("_m", "_at", "_t", "_events", "_reach")


def learn(tokens: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(instance) of those that are known: seeds and what trusted patterns discover, from tokens (pattern, instance, seed).

    A graph joins patterns and the different instances that follow them. Seeds are known. A pattern with
    `support` or more instances, of which a share of `trust` is known, makes all its instances known,
    which next round support other patterns; rounds end when no further pattern is trusted. (Scores that
    pass as means between patterns and instances tend to the same: all instances of a trusted pattern tend to
    its highest score, which is a seed's.) Every pattern and instance of the corpus takes part; a frequent
    one is joined by join_skewed.
    """
    graph = settled(tokens.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    found = settled(graph.groupBy("instance").agg(F.max("seed").alias("known"), F.count("*").alias("n")))
    graph = graph.select("pattern", "instance")
    total = graph.count()
    degree = settled(graph.groupBy("pattern").agg(F.count("*").alias("n")))
    before = 0
    while True:
        share = F.avg(F.col("known").cast("double"))
        trusted = join_skewed(graph, found, "instance", "n", total).groupBy("pattern").agg(share.alias("share"), F.count("*").alias("m"))
        trusted = trusted.where((F.col("m") >= support) & (F.col("share") >= trust)).select("pattern", F.lit(True).alias("trusted"))
        trusted = settled(degree.join(trusted, "pattern", "left"))
        now = trusted.where("trusted").count()
        if now == before:
            return found.where("known").select("instance")
        before = now
        given = join_skewed(graph, trusted, "pattern", "n", total).where("trusted").select("instance", F.lit(True).alias("given")).distinct()
        found = settled(found.join(given, "instance", "left").select("instance", (F.col("known") | F.coalesce("given", F.lit(False))).alias("known"), "n"))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(id, text_hash, base, learned): the spans of each row's text, in code points, end exclusive.

    base and learned are arrays of (start, rank, kind, end) by start; learned ones have the kind "id" and
    overlap no base span. Null text is empty. Rows with the same id and text have the same spans. Long texts are
    searched whole; a text with n matches takes n to the power 1.5 small steps.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _candidates(find_base(rows), "text").select("id", F.xxhash64("text").alias("text_hash"), F.col("_base").alias("base"), "_tokens")
    found = settled(found)
    tokens = found.where(F.size("_tokens") > 0).select("id", "text_hash", F.explode("_tokens").alias("t")).select("id", "text_hash", "t.*")
    known = learn(tokens, support, trust)
    unseen = tokens.where("not seed")
    often = unseen.groupBy("instance").agg(F.count("*").alias("n")).join(known.withColumn("hit", F.lit(True)), "instance", "left")
    more = join_skewed(unseen, often, "instance", "n", unseen.count()).where("hit")
    span = F.struct("start", F.lit(len(PATTERNS)).alias("rank"), F.lit(LEARNED).alias("kind"), "end")
    more = more.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("learned"))
    more = more.withColumnsRenamed({"id": "id2", "text_hash": "hash2"})
    joined = found.join(more, found["id"].eqNullSafe(more["id2"]) & (found["text_hash"] == more["hash2"]), "left")
    none = F.array().cast("array<struct<start: long, rank: int, kind: string, end: long>>")
    return joined.select("id", "text_hash", "base", F.coalesce("learned", none).alias("learned"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of personal data in text_col replaced by its kind in brackets: [EMAIL].

    Of overlapping spans the first is named and all are covered. Null text stays null.
    """
    found = find_personal(docs, id_col, text_col).where((F.size("base") > 0) | (F.size("learned") > 0))
    found = found.groupBy("id", "text_hash").agg(F.first(F.array_sort(F.concat("base", "learned"))).alias("spans"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))
    joined = keyed.join(found, keyed["own"].eqNullSafe(found["id"]) & (keyed["hash"] == found["text_hash"]), "left")
    joined = joined.withColumn("ends", F.coalesce(F.transform("spans", lambda s: s["end"].cast("long")), F.array().cast("array<long>")))
    joined = _running(joined, "upto", "ends", "greatest")
    # What is shown goes on from `at` to `upto`. A block of spans is cut out of the text once, then its spans out of that.
    at = F.slice(F.concat(F.array(F.lit(0).cast("long")), "upto"), 1, F.size("upto"))
    whole = F.arrays_zip(F.transform("spans", lambda s: s["start"].cast("long")).alias("start"), F.transform("spans", lambda s: F.upper(s["kind"])).alias("kind"), at.alias("at"), F.col("upto").alias("upto"))
    joined = joined.withColumn("shown", whole).withColumn("width", F.ceil(F.sqrt(F.size("upto").cast("double"))).cast("int"))
    starts = F.when(F.size("upto") > 0, F.sequence(F.lit(1), F.size("upto"), F.col("width"))).otherwise(F.array().cast("array<int>"))
    joined = joined.withColumn("blocks", F.transform(starts, lambda s: F.slice("shown", s, F.col("width"))))

    def cut(block: Column) -> Column:
        first, end = F.get(block, 0)["at"], F.element_at(block, -1)["upto"]
        return F.struct(block.alias("spans"), first.alias("first"), F.substring(F.col("text"), (first + 1).cast("int"), (end - first).cast("int")).alias("text"))

    def spell(block: Column, x: Column) -> Column:
        gap = F.substring(block["text"], (x["at"] - block["first"] + 1).cast("int"), (x["start"] - x["at"]).cast("int"))
        return F.when(x["start"] < x["at"], "").otherwise(F.concat(gap, F.lit("["), x["kind"], F.lit("]")))

    joined = joined.withColumn("cut", F.transform("blocks", cut))
    said = F.transform("cut", lambda block: F.array_join(F.transform(block["spans"], lambda x: spell(block, x)), ""))
    rest = F.substring(F.col("text"), (F.element_at("upto", -1) + 1).cast("int"), F.length("text"))
    masked = F.when(F.col("spans").isNotNull(), F.concat(F.array_join(said, ""), rest)).otherwise(F.col("text"))
    return joined.select(*(masked.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
