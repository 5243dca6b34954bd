"""Personal data: spans by four patterns, and bootstrapped contextual extraction of what they miss.

The valid matches of the patterns are seeds, each with the words around it. They and tokens of a
kind's rough shape (four digits or more, an at-sign, plain or spelled) make a graph of patterns of
context and instances. A pattern's confidence in a kind is
the sum of its distinct instances' scores over one more than their number; an instance that is no
seed has the score of its surest pattern. After some rounds, the patterns that are sure enough and
have seeds enough give their kind to the instances that they hold. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
_NAME, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The patterns as they are, but for what they need not try: a run that can't match from its start
#: can't from its middle either, unless a match has just ended there, and possessive runs end where
#: the next character can't be theirs. So no text takes time beyond its length.
EMAIL = rf"(?:\G|(?<!{_NAME})){_NAME}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits with at most one blank or dash between, if it has 13 to 19 of them.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
_OPEN, _CLOSE = r"\x20?[(\[{]\x20?", r"\x20?[)\]}]\x20?"
#: An address with its at-sign in brackets, or at-sign and dots in words.
SPELLED = rf"(?<!{_NAME}){_NAME}++(?:{_OPEN}(?i:at|@){_CLOSE}{_HOST}++(?:(?:\.|{_OPEN}(?i:dot|\.){_CLOSE}|\x20(?i:dot)\x20){_HOST}++)++|\x20(?i:at)\x20{_HOST}++(?:\x20(?i:dot)\x20{_HOST}++)++)"
#: What may be an identifier: phone and card numbers and spelled addresses, which can hold blanks, else a token with an at-sign or four digits.
CANDIDATE = rf"{PHONE}|{CARD}|{SPELLED}|(?<!\S)(?=[^\s@]*+@|(?:[^\s0-9]*+[0-9]){{4}})\S+"
#: What stands before a candidate in its token: punctuation, and a label (tel:, ip=).
_LABEL = r"^[^A-Za-z0-9+]*(?:[A-Za-z]++[=:]++[^A-Za-z0-9+]*)?"

ROUNDS = 3
#: Confidence from which a pattern's instances are taken, and the distinct seeds that it then has at least.
CONFIDENCE, SEEDS = 0.8, 4


def located(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, end, text>>, in code points, from what matches and what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.transform(found, lambda m, i: F.struct(F.length(between[i]).alias("gap"), F.length(m).alias("size"), m.alias("text")))
    nothing = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["text"].alias("text"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    walked = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), nothing.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(nothing)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    back = F.split(F.reverse(_digits(x)), "")

    def one(d: Column, i: Column) -> Column:
        v = d.cast("int") * (i % 2 + 1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.filter(back, lambda d: d != ""), one), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(VALID_IP)
    if kind == "card":
        return F.length(_digits(x)).between(13, 19) & _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _context(before: Column, after: Column) -> list[Column]:
    """The two words before and the word after, in lower case, digits as 0, without the punctuation next to the instance."""
    left = F.regexp_extract(F.regexp_replace(F.right(before, F.lit(120)), r"[(\[{<\"']+$", ""), r"(?:\S+\s+)?\S+\s*$", 0)
    right = F.regexp_extract(F.regexp_replace(F.left(after, F.lit(60)), r"^\p{Punct}+", ""), r"^\s*\S+", 0)
    return [F.lower(F.regexp_replace(F.trim(F.regexp_replace(w, r"\s+", " ")), "[0-9]", "0")) for w in (left, right)]


def _matches(text: Column, pattern: str, one: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """``one`` of each match, the text before and the text after it, up to the next matches; ``kind``: the array's type."""
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(located(text, pattern), between, lambda x, before: F.struct(x.alias("x"), before.alias("before")))
    each = F.zip_with(pairs, F.slice(between, 2, 1 << 30), lambda p, after: F.when(p["x"].isNotNull(), one(p["x"], p["before"], after)))
    return F.when(text.rlike(pattern), F.filter(each, lambda x: x.isNotNull())).otherwise(F.array().cast(kind))


def seeds(text: Column) -> dict[str, Column]:
    """array<struct<kind, start, end, core, left, right>> by kind: leftmost matches that don't overlap, without
    those that fail their check, and the two words before and the word after."""
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

    def of(kind: str) -> Column:
        def one(x: Column, before: Column, after: Column) -> Column:
            left, right = _context(before, after)
            full = F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("core"), left.alias("left"), right.alias("right"))
            return F.when(_valid(kind, x["text"]), full)

        return _matches(text, patterns[kind], one, "array<struct<kind:string,start:int,end:int,core:string,left:string,right:string>>")

    return {k: of(k) for k in KINDS}


def _candidates(text: Column) -> Column:
    """array<struct<start, end, core, left, right>>: identifier-like tokens without label and the punctuation around them,
    the two words before (a label is one) and the word after."""

    def one(x: Column, before: Column, after: Column) -> Column:
        label = F.regexp_extract(x["text"], _LABEL, 0)
        core = F.regexp_extract(F.substring(x["text"], F.length(label) + 1, F.length(x["text"])), r"[A-Za-z0-9+](?s:.*)[A-Za-z0-9]", 0)
        start = x["start"] + F.length(label)
        left, right = _context(F.concat(before, label), after)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("core"), left.alias("left"), right.alias("right"))

    return _matches(text, CANDIDATE, one, "array<struct<start:int,end:int,core:string,left:string,right:string>>")


def edges(found: DataFrame) -> DataFrame:
    """(pattern, core, seed): the distinct edges of the graph, from rows with ``seeds`` and ``candidates``."""
    open_ = F.transform("candidates", lambda c: F.struct(c["core"].alias("core"), c["left"].alias("left"), c["right"].alias("right"), F.lit(None).cast("string").alias("seed")))
    known = F.transform("seeds", lambda c: F.struct(c["core"].alias("core"), c["left"].alias("left"), c["right"].alias("right"), c["kind"].alias("seed")))
    each = found.select(F.explode(F.concat(open_, known)).alias("c")).select("c.*").where("length(core) > 0")
    last = F.regexp_extract("left", r"\S+$", 0)
    patterns = F.array(F.when(F.col("left").contains(" "), F.concat(F.lit("before "), F.col("left"))), F.when((F.length(last) > 0) & (F.length("right") > 0), F.concat(F.lit("around "), last, F.lit(" _ "), F.col("right"))))
    return each.select(F.explode(patterns).alias("pattern"), "core", "seed").where("pattern is not null").distinct()


def sure_patterns(graph: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are sure after ``rounds``."""
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = graph.where("seed is not null").select("core", F.col("seed").alias("kind"), F.lit(1.0).alias("score"), F.lit(1).alias("is_seed")).distinct()
    for k in range(rounds):
        sums = graph.join(scores, "core").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.sum("is_seed").alias("seeds"))
        sure = written(sums.where(F.col("seeds") > 0).join(sizes, "pattern").select("pattern", "kind", "seeds", (F.col("s") / (F.col("n") + 1)).alias("confidence")), "patterns")
        if k + 1 < rounds:
            known = graph.where("seed is not null").select("core", F.col("seed").alias("kind"), F.lit(1.0).alias("score"), F.lit(1).alias("is_seed")).distinct()
            open_ = graph.where("seed is null").join(sure, "pattern").groupBy("core", "kind").agg(F.max("confidence").alias("score"), F.lit(0).alias("is_seed"))
            scores = written(known.unionByName(open_), "instances")
    return sure.where((F.col("confidence") >= confidence) & (F.col("seeds") >= seeds)).select("pattern", "kind", "confidence")


def discovered(found: DataFrame, graph: DataFrame, sure: DataFrame) -> DataFrame:
    """(key columns, more): spans array<struct<kind, start, end>> that sure patterns add; candidates lie outside all base spans."""
    taken = graph.where("seed is null").join(sure, "pattern")
    # numbers stay numbers: only an address may hold letters
    taken = taken.where((F.col("kind") == "email") | ~F.col("core").rlike("[A-Za-z]"))
    taken = taken.groupBy("core", "pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence"))
    each = found.select("__id", "__hash", F.explode("candidates").alias("c"))
    last = F.regexp_extract("c.left", r"\S+$", 0)
    both = F.array(F.concat(F.lit("before "), F.col("c.left")), F.concat(F.lit("around "), last, F.lit(" _ "), F.col("c.right")))
    each = each.withColumn("pattern", F.explode(both)).withColumn("core", F.col("c.core"))
    hit = each.join(taken, ["core", "pattern"])
    hit = hit.groupBy("__id", "__hash", F.col("c.start").alias("start"), F.col("c.end").alias("end")).agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    return hit.groupBy("__id", "__hash").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__id": F.col(id_col), "__hash": F.xxhash64(text), "__text": text})


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __hash, base, more): one row per row of ``docs``.

    base and more: array<struct<kind, start, end>>, the patterns' spans by kind in the order of
    ``KINDS``, then start; and those that the method adds. Null texts are empty, which have none.
    Rows that repeat an id and a text get the same spans; other columns are not read. Rows are
    told apart by id and a 64-bit hash of the text.
    """
    rows = _keyed(docs.select(id_col, text_col), id_col, text_col)
    found = rows.select("__id", "__hash", F.concat(*seeds(F.col("__text")).values()).alias("seeds"), _candidates(F.col("__text")).alias("candidates"))
    found = written(found, "pii")
    base = F.transform("seeds", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    # what a seed lies in is no instance of its own
    apart = F.filter("candidates", lambda c: ~F.exists("seeds", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = found.select("__id", "__hash", "seeds", base.alias("base"), apart.alias("candidates"))
    graph = written(edges(found), "graph")
    more = discovered(found, graph, sure_patterns(graph)).select(F.col("__id").alias("i"), F.col("__hash").alias("h"), "more")
    joined = found.join(more, found["__id"].eqNullSafe(F.col("i")) & (found["__hash"] == F.col("h")), "left")
    return joined.select("__id", "__hash", "base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("more"))


def _order(kind: Column) -> Column:
    return reduce(lambda c, k: c.when(kind == k[1], k[0]), enumerate(KINDS[1:], 1), F.when(kind == KINDS[0], 0))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _sorted(spans: Column) -> Column:
    keyed = F.transform(spans, lambda x: F.struct(_order(x["kind"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.sort_array(keyed)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans): counts and digest of the patterns' spans, all spans and their number."""
    rows = spans(docs, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(F.col("__id").alias(id_col), *map(count, KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(_sorted(F.concat("base", "more"))).alias("spans"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with [EMAIL], [IP], [CARD] or [PHONE] for each span in its text; of spans that overlap, the
    first in the text stands and the rest of the others goes with it. Null texts stay null."""
    found = spans(docs, id_col, text_col).where(F.size("base") + F.size("more") > 0)
    by_place = F.sort_array(F.transform(F.concat("base", "more"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["kind"]).alias("kind"))))
    found = found.select(F.col("__id").alias("__i"), F.col("__hash").alias("__h"), by_place.alias("__spans")).distinct()
    rows = _keyed(docs, id_col, text_col)
    rows = rows.join(found, rows["__id"].eqNullSafe(F.col("__i")) & (rows["__hash"] == F.col("__h")), "left")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(F.substring(F.col("__text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate("__spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("__text"), acc["at"] + 1, F.length("__text"))))
    return rows.withColumn(text_col, F.when(F.col("__spans").isNotNull(), new).otherwise(F.col(text_col))).select(*docs.columns)
