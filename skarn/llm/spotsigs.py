"""SpotSigs fingerprints: chains of content words after common words.

The corpus' most frequent words are its anchors. Each content word (a word that is no anchor) that
anchors precede is a spot; its signature has those anchors, the word and the content word after it.
Where no anchor comes for some words each word starts a chain of words. A document's fingerprint is
its set of signatures. Near duplicates are found among sets of like length only: sets are
partitioned by length so that any pair within the threshold shares a partition, and are then
compared by Jaccard where the rarest signatures of one, which alone can decide, meet those of the
other. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce
from math import log
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_buckets, joined_by_key, removed, written
from .components import components

#: Anchors a round, and rounds.
ANCHORS, ROUNDS = 24, 4
#: A document has anchors enough if it holds so many of them, or one among each ``SPARSE`` of its distinct words.
ENOUGH = 8
#: Words after an anchor beyond which each word starts a chain, up to the next anchor.
SPARSE = 16
SIMILARITY = 0.8
#: 64-bit words of a set's sketch.
SKETCH = [f"k{k}" for k in range(8)]
#: Length classes to a partition; a class holds lengths within the similarity of each other.
BANDS = 4
#: Sets up to which a group that its pivots don't settle is compared as it is, and pivots that it gets before.
LARGE, PIVOTS = 64, 3
#: What separates words: all but letters and digits.
_BREAK = r"[^\p{L}\p{N}]+"
#: A character that no word holds, written after an anchor instead of a blank.
_MARK = "\u0001"
_ALL = 1 << 30


def _words(text: Column) -> Column:
    """Lower-cased words in order; of a text without any, the empty word."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), _BREAK, " ")), " ")


def anchor_words(docs: DataFrame, text_col: str = "text", most: int = ANCHORS, rounds: int = ROUNDS) -> list[str]:
    """Words that most documents hold, at most ``most`` in each round, ties in order of the word.

    The first round counts all documents, each later one those that hold too few anchors as yet (of
    another language, say). The documents' distinct words are written once and read by all rounds;
    they are summed where they are read before they are shuffled.
    """
    rows, found = written(docs.select(F.array_distinct(_words(F.coalesce(text_col, F.lit("")))).alias("ws")), "words"), []
    for _ in range(rounds):
        held = F.size(F.filter("ws", lambda w: w.isin(found)))
        open_ = rows.where((held < ENOUGH) & (held * SPARSE < F.size("ws"))) if found else rows
        words = open_.select(F.explode("ws").alias("w")).where((F.col("w") != "") & ~F.col("w").isin(found))
        top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()
        if not top:
            break
        found += [r["w"] for r in top]
    removed(docs.sparkSession, rows)
    return found


def with_signatures(df: DataFrame, text_col: str, out: str, anchors: list[str]) -> DataFrame:
    """``df`` with ``out``: the sorted distinct 32-bit hashes of the text's signatures.

    In a run of words without anchors, those after the first ``SPARSE`` start a chain of three words
    each, up to the next anchor (texts in another language, lists of numbers). The text's beginning is a
    signature too, so a text without words alone has none. Which places start chains is told by
    the words right before them, so an edit changes only the signatures around it. Null is the empty text.
    """
    glued = F.array_join(F.transform(_words(F.coalesce(text_col, F.lit(""))), lambda w: F.concat(w, F.when(w.isin(anchors), _MARK).otherwise(" "))), "")
    rows = df.withColumn("__glued", glued)
    # a content word stands in one piece with the anchors before it
    rows = rows.withColumn("__pieces", F.split("__glued", " "))
    # columns of their own, for what is used twice is made once then
    spots = F.zip_with("__pieces", F.slice("__pieces", 2, _ALL), lambda w, x: F.when(F.contains(w, F.lit(_MARK)), F.hash(w, F.substring_index(x, _MARK, -1))))
    runs = F.filter(F.split("__glued", _MARK), lambda r: (F.length(r) > 2 * SPARSE) & (F.length(r) - F.length(F.replace(r, F.lit(" "))) > SPARSE))
    chains = F.transform(F.transform(runs, lambda r: F.split(F.rtrim(r), " ")), lambda ws: F.transform(F.sequence(F.lit(SPARSE + 1), F.size(ws)), lambda i: F.hash(F.slice(ws, i, 3))))
    first = F.array(F.hash(F.lit(""), F.substring_index("__glued", " ", 2)))
    every = F.concat(F.filter(spots, lambda h: h.isNotNull()), F.flatten(chains), first)
    return rows.withColumn(out, F.when(F.col("__glued") == " ", F.array().cast("array<int>")).otherwise(F.sort_array(F.array_distinct(every)))).drop("__glued", "__pieces")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def text_form(sigs: Column) -> Column:
    """A fingerprint as a string: its signatures as hexadecimal numbers of 8 digits, one after the other."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.right(F.concat(F.lit("0000000"), F.hex(x)), F.lit(8)))), "")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id): the least id that pairs of ``similarity`` or more lead to.

    One row per row of ``docs``; null texts are empty, and texts of equal signatures are one class
    before any comparison.
    """
    anchors = anchor_words(docs, text_col) if anchors is None else anchors
    sets = with_signatures(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", "s", anchors).select("id", "s")
    return classes(written(sets, "signatures"), similarity).withColumnRenamed("id", id_col)


def classes(sets: DataFrame, similarity: float = SIMILARITY, large: int = LARGE) -> DataFrame:
    """(id, class_id) of ``sets`` (id, s: sorted distinct hashes): as ``near_duplicates``, from signatures that are there already."""
    rows = sets.select("id", F.xxhash64("s").alias("c"))
    return joined_by_key(rows, class_ids(sets, similarity, large), ["c"]).select("id", "class_id")


def _sketch(s: Column) -> list[Column]:
    """The words of a sketch, each bit of which says whether an odd number of the set's hashes fall on it: sets that differ in d hashes differ in d bits at most."""

    def word(k: int) -> Column:
        own = F.filter(s, lambda x: F.pmod(F.call_function("shiftright", x, F.lit(6)), F.lit(len(SKETCH))) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)))))

    return [word(k).alias(name) for k, name in enumerate(SKETCH)]


def _may_reach(similarity: float, a: str, b: str) -> Column:
    """Whether lengths (len) and sketches let two sets reach the similarity; ``a``, ``b``: how their columns are called."""
    x, y = (F.col(n.format("len")) for n in (a, b))
    bits = reduce(add, (F.bit_count(F.col(a.format(k)).bitwiseXOR(F.col(b.format(k)))) for k in SKETCH))
    return (F.least(x, y) >= F.greatest(x, y) * similarity - 1e-9) & (bits <= (x + y) * (1 - similarity) / (1 + similarity) + 1e-6)


def _shared_heads(reps: DataFrame, similarity: float) -> DataFrame:
    """(c, prefix, head) of the ``reps`` (c, s) whose prefix, in the order of how many sets hold a signature and then of the signature, has
    signatures that other sets hold too: those in order, up to one behind the prefix, and how many are within it.

    Signatures of one set alone come first and meet none, so they are only counted.
    """
    sigs = reps.select("c", F.size("s").alias("len"), F.explode("s").alias("sig"))
    total = reps.agg(F.coalesce(F.sum(F.size("s")), F.lit(0))).first()[0]
    counts = written(sigs.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig", "n", F.col("n").alias("k")), "counts")
    # a list is as long as its set at most
    lists = joined_by_key(sigs, counts, ["sig"], total).groupBy("c", "len").agg(F.sort_array(F.collect_list(F.struct("k", "sig"))).alias("list"))
    prefix = F.col("len") - F.ceil(F.col("len") * similarity - 1e-9).cast("int") + 1 - (F.col("len") - F.size("list"))
    lists = lists.withColumn("prefix", prefix).where("prefix > 0").select("c", "prefix", F.slice("list", 1, F.col("prefix") + 1)["sig"].alias("head"))
    out = written(lists, "heads")
    removed(reps.sparkSession, counts)
    return out


def _linked(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``reps`` (c, len, s, sketch) that are similar enough. Lengths and sketches are compared first: for pairs that reach the
    similarity neither the lengths nor the sketches' bits can differ by more than their hashes may. Only what is left fetches its sets."""
    pairs = written(pairs.distinct(), "pairs")
    names = ["len", *SKETCH]
    light = reps.select("c", *names)
    often = pairs.groupBy("b").agg(F.count("*").alias("n"))
    met = joined_by_key(pairs, light.toDF("b", *(f"{k}_b" for k in names)).join(often, "b"), ["b"]).join(light.toDF("a", *(f"{k}_a" for k in names)), "a")
    met = met.where(_may_reach(similarity, "{}_a", "{}_b"))
    near = written(met.select("a", "b"), "near")
    often = near.groupBy("b").agg(F.count("*").alias("n"))
    both = joined_by_key(near, reps.select(F.col("c").alias("b"), F.col("s").alias("sb")).join(often, "b"), ["b"])
    both = both.join(reps.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    found = written(both.where(jaccard(F.col("sa"), F.col("sb")) >= similarity - 1e-9).select("a", "b"), "links")
    for table in (pairs, near):
        removed(reps.sparkSession, table)
    return found


def class_ids(sets: DataFrame, similarity: float = SIMILARITY, large: int = LARGE, rounds: int = PIVOTS) -> DataFrame:
    """(c, n, class_id): for each distinct set its 64-bit hash, how many of ``sets`` (id, s) are equal to it, and its class.

    Sets are partitioned by the logarithm of their length; those whose partners can be in the next
    partition are offered there too. Within a partition only sets are compared that share one of their
    prefix signatures: in an order of all signatures, rare ones first, a pair that reaches the
    similarity shares one of the first few, as many as leave fewer than the pair must share. How
    many sets hold a signature is counted, whatever their number; sets that share none of their
    prefix with others go no further. Equal sets (by a 64-bit hash) are one, empty sets too.

    Each group of a signature and a partition has a pivot, another one in each of ``rounds`` rounds, to which those are compared that
    aren't in one component with it yet; groups that lie within one component are done. So a large group of near copies costs a
    comparison for each. Of the groups that are still open, those in different components are compared with each other; groups of more
    than ``large`` sets are parted by a second signature first, which a pair must share as well if the prefix is one longer. No pair
    that would join two components is left out.
    """
    spark = sets.sparkSession
    sets = sets.withColumn("c", F.xxhash64("s"))
    reps = sets.groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("s").alias("s"))
    reps, n = written(reps, "classes"), F.size("s")
    band = F.floor(F.log(n) / log(1 / similarity) + 1e-9).cast("int")
    part = F.floor(band / BANDS).cast("int")
    parts = F.when(F.pmod(band, F.lit(BANDS)) == BANDS - 1, F.array(part, part + 1)).otherwise(F.array(part))
    shared = _shared_heads(reps, similarity)
    ordered = written(reps.join(shared, "c").select("c", "s", n.alias("len"), "prefix", parts.alias("parts"), "head", *_sketch(F.col("s"))), "ordered")
    heads = ordered.select("c", "len", "parts", F.explode(F.slice("head", 1, F.col("prefix"))).alias("sig")).select("c", "len", "sig", F.explode("parts").alias("part"))
    total = ordered.agg(F.coalesce(F.sum(F.least("prefix", F.size("head")) * F.size("parts")), F.lit(0))).first()[0]
    group = ["sig", "part"]
    groups = heads.groupBy(*group).agg(F.min("c").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = written(joined_by_key(heads, groups.withColumn("size", F.col("n")), group, total).select(*group, "c", "len", "size", "pivot"), "members")
    links = _linked(members.where("c <> pivot").select(F.col("c").alias("a"), F.col("pivot").alias("b")), ordered, similarity)
    members, roots = members.drop("pivot"), components(links)

    def opened(rows: DataFrame, number: int) -> DataFrame:
        """The members of groups that lie in several components, each with its root, and the pivot of round ``number`` with its own."""
        rooted = rows.join(roots, F.col("c") == F.col("v"), "left").select(*group, "c", "len", "size", F.coalesce("m", "c").alias("root"))
        rooted = written(rooted, "rooted")
        pick = F.min(F.struct(F.xxhash64("c", F.lit(number)).alias("h"), "c", "root"))
        some = rooted.groupBy(*group).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), pick.alias("one")).where("low <> high")
        some = some.select(*group, "n", F.col("one")["c"].alias("pivot"), F.col("one")["root"].alias("pivot_root"))
        return written(joined_by_key(rooted, written(some, "open"), group), "members")

    for number in range(1, rounds):
        members = opened(members, number)
        asked = members.where("root <> pivot_root").select(F.greatest("c", "pivot").alias("a"), F.least("c", "pivot").alias("b"))
        more = _linked(asked, ordered, similarity)
        members = members.select(*group, "c", "len", "size")
        if not more.limit(1).count():
            break
        links = written(roots.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(more), "links")
        roots = components(links)
    members = opened(members, rounds)
    kept = members

    def met(rows: DataFrame, on: list[str]) -> DataFrame:
        """Pairs of a group that are in different components, of those outside the pivot's one with all, and may be similar enough."""
        x, y = rows.where("root <> pivot_root").alias("p"), rows.alias("q")
        same = (F.col("p.root") != F.col("q.root")) & _may_reach(similarity, "p.{}", "q.{}")
        for k in on:
            same = same & (F.col(f"p.{k}") == F.col(f"q.{k}"))
        return x.join(y, same).select(F.greatest("p.c", "q.c").alias("a"), F.least("p.c", "q.c").alias("b"))

    more = ordered.select(F.col("c").alias("o"), "head", *SKETCH)
    members = members.join(more, F.col("c") == F.col("o")).select(*group, "c", "len", "size", "root", "pivot_root", *SKETCH, "head")
    seconds = members.where(F.col("size") > large).withColumn("second", F.explode("head")).drop("head").where("second <> sig")
    members = members.drop("head")
    last = _linked(met(members.where(F.col("size") <= large), group).unionByName(met(seconds, [*group, "second"])), ordered, similarity)
    roots = components(roots.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(last))
    joined = reps.join(roots, reps["c"] == roots["v"], "left").select("c", "copies", "least", F.coalesce("m", "c").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("class_id"))
    out = written(joined.join(least, "root").select("c", F.col("copies").alias("n"), "class_id"), "class-ids")
    for table in (reps, shared, ordered, kept):
        removed(spark, table)
    return out


def _with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (i, t) with bucket and guest: each bucket of neighbouring ids has as a guest the row that comes before
    its first, the greatest of all before the least. Rows of null id are spread over buckets of their own."""
    spark, own = rows.sparkSession, rows.where("i is not null")
    bucket = id_buckets(own, "i")
    # a row for a bucket, and of those there are a few thousand at most
    tops = sorted(own.groupBy(bucket.alias("bucket")).agg(F.max("i").alias("top")).collect())
    hosts = [(b, tops[k - 1]["top"]) for k, (b, _) in enumerate(tops)]
    hosts = spark.createDataFrame(hosts, "host int, i long")
    # of rows that repeat an id the greatest text
    guests = own.join(F.broadcast(hosts.select("i").distinct()), "i", "left_semi").groupBy("i").agg(F.max("t").alias("t"))
    guests = guests.join(F.broadcast(hosts), "i").select("i", "t", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    placed = rows.withColumns({"bucket": F.coalesce(bucket, -1 - F.pmod(F.xxhash64("t"), F.lit(4096)).cast("int")), "guest": F.lit(False)})
    return placed.unionByName(guests)


def edited_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] | None = None, with_classes: bool = False) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id if asked for).

    The edited text: the last third of the code points (rounded down) replaced by the first as many
    of the next document's, the one before it in the order of (id, text); the last is next to the
    first, and a single document to itself. Rows of null id have no place in the order and are their
    own next. Null texts are empty, two empty fingerprints alike; other columns are not read.

    Documents of neighbouring ids are dealt to one bucket, so that the next text is at hand; only
    the first of each bucket gets it from another. Buckets follow the ids' percentiles. class_id is that
    of ``near_duplicates``; null where all ids of a class are.
    """
    anchors = anchor_words(docs, text_col) if anchors is None else anchors
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    dealt = _with_next(rows).repartition("bucket").sortWithinPartitions("bucket", ~F.col("guest"), "i", "t")
    dealt = with_signatures(dealt, "t", "s", anchors)
    w = Window.partitionBy("bucket").orderBy(~F.col("guest"), "i", "t")
    near = dealt.withColumns({"pt": F.lag("t").over(w), "ps": F.lag("s").over(w)}).where(~F.col("guest"))
    alone = F.col("i").isNull()
    near = near.select("i", "t", "s", F.when(alone, F.col("t")).otherwise(F.col("pt")).alias("next"), F.when(alone, F.col("s")).otherwise(F.col("ps")).alias("next_s"), F.length("t").alias("n"))
    edited = F.concat(F.substring(F.col("t"), F.lit(1), F.expr("n - n div 3")), F.substring(F.col("next"), F.lit(1), F.expr("n div 3")))
    near = with_signatures(near.select("i", "n", "s", "next_s", edited.alias("e")), "e", "es", anchors)
    near = near.select(
        "i", "n", F.sha2(F.col("e").cast("binary"), 256).alias("sha"), "s", "es", F.xxhash64("s").alias("c"),
        jaccard(F.col("s"), F.col("es")).alias("near_edited"), jaccard(F.col("s"), F.col("next_s")).alias("near_next"),
    )
    if with_classes:
        near = written(near, "spots")
        near = joined_by_key(near, class_ids(near.select(F.col("i").alias("id"), "s")), ["c"])
    return near.select(
        F.col("i").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        text_form(F.col("s")).alias("fingerprint"),
        text_form(F.col("es")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        *(["class_id"] if with_classes else []),
    )
