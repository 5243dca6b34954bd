"""Spelling variants: words that differ by one letter, and the frequent form that each of them stands for.

A word's mask has a bit for each letter that it holds an odd number of times. An edit flips one bit (a letter more or less) or
two (one letter for another). Masks are split into three bands, and words are joined on equal bands: an edit whose flips lie in
one band leaves the other two equal; if they lie in two bands the third is equal, and each of the two has one bit more or less,
so its number of bits changes parity. Lengths and masks are compared before the words themselves. Everything is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, removed, written

# The letters, lower-cased A to Z and U+00C0 to U+00FF.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "[a-zÀ-ÿ]+"
BANDS = 3
#: One word in so many loses a letter; shortest word, fewest occurrences, how much more frequent a form is.
DAMAGED, LEAST_LENGTH, LEAST_COUNT, RATIO = 97, 5, 3, 2


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int | None = DAMAGED) -> DataFrame:
    """(word, n): words of at least ``LEAST_LENGTH`` letters and their occurrences, ``LEAST_COUNT`` or more.

    ``damaged``: a run of letters loses one where a checksum of id and run (in lower case) is divisible by it; None: no run does. A
    null id counts as an empty one.
    """
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    number = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    words = docs.select(number.alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"({_RUN})"), F.lit(1))).alias("run"))
    if damaged is not None:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        words = words.where(F.length("run") >= LEAST_LENGTH).withColumn("h", h).withColumn("run", F.when(F.pmod(F.col("h"), F.lit(damaged)) == 0, cut).otherwise(F.col("run")))
    counts = words.where(F.length("run") >= LEAST_LENGTH).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def bands(words: DataFrame) -> list[str]:
    """The letters of each band, dealt out by how many words hold them an odd number of times, so that the bands tell about equally much."""
    odd = F.filter(F.array_distinct(F.split("word", "")), lambda c: (c != "") & (F.pmod(F.length("word") - F.length(F.replace(F.col("word"), c, F.lit(""))), F.lit(2)) == 1))
    found = {r["c"]: r["n"] for r in words.select(F.explode(odd).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row for each letter
    out = ["" for _ in range(BANDS)]
    for k, c in enumerate(sorted(LETTERS, key=lambda c: (-found.get(c, 0), c))):
        place = k % (2 * BANDS)
        out[min(place, 2 * BANDS - 1 - place)] += c
    return out


def masks(words: DataFrame, letters: list[str]) -> DataFrame:
    """``words`` with its length and the bands b0, b1, b2 of its mask, the first letter of a band at bit 1."""

    def mask(own: str) -> Column:
        bits = F.expr(f"aggregate(split(word, ''), 0, (a, c) -> a ^ if(c = '', 0, shiftleft(1, instr('{own}', c))))")
        return bits.bitwiseAND(F.lit((1 << 31) - 2))

    return words.withColumn("len", F.length("word")).withColumns({f"b{k}": mask(own) for k, own in enumerate(letters)})


def _spread(left: DataFrame, right: DataFrame, key: list[str], on: Column) -> DataFrame:
    """Inner join on ``key`` and ``on``. Where one in ``HOT_KEYS`` of the left rows or more share a key they are dealt to several tasks, and
    the key's right rows go to each of them. Hot keys are ``HOT_KEYS`` at most, so they are broadcast."""
    total = left.count()
    most = max(1000, total // HOT_KEYS)
    hot = left.groupBy(*key).agg(F.count("*").alias("members")).where(F.col("members") > most).select(*key, F.ceil(F.col("members") / most).cast("int").alias("tasks"))
    hot = written(hot, "hot-bands", rows=1)
    tasks = F.coalesce("tasks", F.lit(1))
    a = left.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64("word"), tasks).cast("int")).drop("tasks")
    b = right.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks")
    a, b = a.alias("l"), b.alias("r")
    same = F.lit(True)
    for k in [*key, "salt"]:
        same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return a.join(b, same & on).select(F.col("l.word").alias("a"), F.col("l.n").alias("n_a"), F.col("r.word").alias("b"), F.col("r.n").alias("n_b"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of different words (word, n) that one inserted, deleted or replaced letter turns into each other, once."""
    known = written(masks(words, bands(words)), "masks")
    others = {i: [j for j in range(BANDS) if j != i] for i in range(BANDS)}

    def ones(column: str) -> Column:
        return F.bit_count(F.col(f"l.{column}").bitwiseXOR(F.col(f"r.{column}")))

    edit = F.levenshtein(F.col("l.word"), F.col("r.word"), 1) == 1

    # flips in one band, the others equal: a letter more (the right word is longer), or one for another
    def two_equal(more: int) -> list[Column]:
        return [F.struct(F.lit(i).alias("band"), *(F.col(f"b{j}").alias(f"k{k}") for k, j in enumerate(others[i])), (F.col("len") - more).alias("size"), F.col(f"b{i}").alias("rest")) for i in range(BANDS)]

    key = ["band", "k0", "k1", "size"]
    left = known.select("word", "n", "len", F.explode(F.array(*two_equal(0))).alias("e")).select("word", "n", "len", "e.*")
    right = known.select("word", "n", "len", F.explode(F.array(*two_equal(0), *two_equal(1))).alias("e")).select("word", "n", "len", "e.*")
    one = F.when(F.col("l.len") == F.col("r.len"), (F.col("l.word") < F.col("r.word")) & (ones("rest") == 2)).otherwise(ones("rest") == 1)
    first = _spread(left, right, key, one & edit)

    # flips in two bands, the third equal: of such words one has an odd, one an even number of bits in a band
    split = [F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("k0"), F.col("len").alias("size"), *(F.col(f"b{j}").alias(f"rest{k}") for k, j in enumerate(others[i]))) for i in range(BANDS)]
    every = known.select("word", "n", F.explode(F.array(*split)).alias("e")).select("word", "n", "e.*").withColumns({f"odd{k}": F.bit_count(F.col(f"rest{k}")).bitwiseAND(F.lit(1)) for k in range(2)})
    even, odd = every.where("odd0 = 0").drop("odd0"), every.where("odd0 = 1").withColumn("odd1", 1 - F.col("odd1")).drop("odd0")
    second = _spread(even, odd, ["band", "k0", "size", "odd1"], (ones("rest0") == 1) & (ones("rest1") == 1) & edit)
    return first.unionByName(second)


def forms(words: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near): for each word its near word of most occurrences (ties: the least in code-point order), if it has
    ``RATIO`` times the word's or more, else null; and how many near words it has."""
    pairs = written(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("w")).alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("m"), F.col("a").alias("w")).alias("near"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    found = words.join(best, "word", "left")
    is_form = -F.col("best.m") >= RATIO * F.col("n")
    return found.select("word", "n", F.when(is_form, F.col("best.w")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root): of each word that has a form the last one that forms lead to. Each form has twice its word's occurrences, so chains have 63
    links at most, and each of six rounds doubles what is passed over."""
    spark = found.sparkSession
    links = written(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("w"), F.col("root").alias("next"))
        more = links.join(ahead, F.col("root") == F.col("w"), "left")
        moved = written(more.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        removed(spark, links)
        links = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int | None = DAMAGED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``vocabulary``; root: the word itself where it has no form.

    Null, empty and word-free texts have no words, and empty tables no rows. Repeated rows count as often as they come. Texts are
    taken whole, however long, and other columns are not read.
    """
    words = written(vocabulary(docs, id_col, text_col, damaged), "words")
    found = written(forms(words), "forms")
    out = found.join(roots(found), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
