"""Operator 5: quality rules and a hashed n-gram log-likelihood ratio. DataFrame functions only, no shuffle of texts.

The model is two multinomials over hashed one- and two-word grams: one of a trusted target (labelled rows), one of the
raw corpus (every document). A document's score is the mean over its grams of log p_target - log p_raw; documents under the threshold are
rejected. The threshold comes from all labelled rows, each scored by a model without it: so it follows the corpus, and in a small one, where
grams that no trusted row has are common in clean texts too, it is lower. Model and threshold take every label: labels meet the documents as bits of
64 neighbouring ids a row, and the threshold is an order statistic found by counting. The corpus counts are summed before they are shuffled: a row per bucket and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]+"
#: Hash buckets of the model; also the size of the table that goes to every task.
BUCKETS = 1 << 15
#: Least mean log-likelihood ratio of a kept document, in nats a gram, where no labelled rows tell it.
THRESHOLD = -0.15
#: Parts that trusted rows are dealt into; the rows of a part are scored by the model of the others.
PARTS = 5
#: Labels go to every task in at most so many rows, each of up to 64 ids; more meet the documents in a join that Spark plans. The result is the same.
MAX_SENT = 1 << 20
#: Bins of a pass that looks for a rank; a bound of speed alone.
BINS = 1 << 12
#: Share of trusted rows that the threshold may reject at most.
MAX_LOSS = 0.01
MIN_WORDS = 50
#: Ratios are held as integers in this part of a nat, so that sums are exact in any order.
UNIT = 10_000
JUDGED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]


def hashes(text: Column) -> Column:
    """A 64-bit hash per word of a text, in order; an array without elements for null."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(h: Column, buckets: int) -> Column:
    """Buckets of a text's one- and two-word grams."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size(h) - 1, F.lit(0))))


def windows(h: Column) -> Column:
    """A hash per three-word window of a text, from its words' hashes."""
    n = F.size(h)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))).otherwise(F.array().cast("array<long>"))


def in_order(tri: Column) -> Column:
    """Windows and their places, equal ones side by side; null for texts without a repeated window, the most, which need no sort."""
    return F.when(F.size(F.array_distinct(tri)) < F.size(tri), F.sort_array(F.transform(tri, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))


def covered(order: Column) -> Column:
    """Words under repeated windows. order has to be a column that is there already: it is looked up for each element."""
    last = F.size(order) - 1
    twice = F.filter(
        F.transform(order, lambda s, k: F.when(((k > 0) & (F.get(order, k - 1)["x"] == s["x"])) | ((k < last) & (F.get(order, k + 1)["x"] == s["x"])), s["i"])),
        lambda i: i.isNotNull(),
    )
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))


def part_of(key: str) -> Column:
    """The part, from 1 on, of a trusted row."""
    return (F.pmod(F.xxhash64(F.lit("part"), key), F.lit(PARTS)) + 1).cast("int")


def label_keys(labels: DataFrame, key: str, max_trusted: int | None = None) -> DataFrame:
    """Labelled keys, once each, and whether they are trusted or bad. Rows of quality 1 and toxic 0 are trusted, if max_trusted is given the first by hash alone; keys of quality 0 without such a row are bad."""
    is_good, is_bad = F.coalesce(F.expr("quality = 1 AND coalesce(toxic, 0) = 0"), F.lit(False)), F.coalesce(F.expr("quality = 0"), F.lit(False))
    out = labels.groupBy(key).agg(F.max(is_good).alias("good"), F.max(is_bad).alias("bad")).where(F.col(key).isNotNull() & (F.col("good") | F.col("bad")))
    if max_trusted is None:
        return out
    good = out.where("good")
    return good.orderBy(F.xxhash64(key), key).limit(max_trusted).unionByName(out.where("NOT good"))


def with_parts(docs: DataFrame, keys: DataFrame, *, key: str, part: str) -> DataFrame:
    """docs and the column part: a trusted row's part, 0 for bad ones, null for others. keys: of label_keys()."""
    integers = {"tinyint", "smallint", "int", "bigint"}
    dense = {dict(t.dtypes)[key] for t in (docs, keys)} <= integers
    word, bit = (F.shiftright(F.col(key).cast("long"), 6), F.col(key).cast("long").bitwiseAND(F.lit(63)).cast("int")) if dense else (F.col(key), F.lit(0))
    w, good, bad = (free_name(docs, x) for x in ("__w", "__good", "__bad"))
    keys = keys.select(word.alias(w), bit.alias("bit"), F.col("good").alias(good), F.col("bad").alias(bad))
    mask = lambda c: F.coalesce(F.bit_or(F.when(c, F.expr("shiftleft(1L, bit)"))), F.lit(0).cast("long"))
    words = stored(keys.groupBy(w).agg(mask(F.col(good)).alias(good), mask(F.col(bad) & ~F.col(good)).alias(bad)))
    if words.count() <= MAX_SENT:
        words = F.broadcast(words)
    own = F.when(F.getbit(good, bit) == 1, part_of(key)).when(F.getbit(bad, bit) == 1, 0)
    return docs.join(words, word == F.col(w), "left").select(*docs.columns, own.alias(part))


def model(docs: DataFrame, *, text: str, part: str, buckets: int) -> DataFrame:
    """One row: llr, by part and bucket log p_target - log p_raw in 1/UNIT nats, both with one added to each count; and g, the trusted rows' grams.

    Part 0 has all trusted rows on its target side, part k all but those of part k. docs: of with_parts().
    """
    d = docs.select(F.col(part).alias("part"), hashes(F.col(text)).alias("__h")).select("part", F.explode(grams(F.col("__h"), buckets)).alias("b"))
    parts = range(1, PARTS + 1)
    counts = d.groupBy("b").agg(F.count("*").alias("raw"), *(F.count(F.when(F.col("part") == k, 1)).alias(f"p{k}") for k in parts))
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0, ["raw", *(f"p{k}" for k in parts)])
    every = every.withColumn("p0", sum((F.col(f"p{k}") for k in parts), F.lit(0).cast("long")))
    names = [f"p{k}" for k in range(PARTS + 1)]
    row = every.agg(F.sort_array(F.collect_list(F.struct("b", "raw", *names))).alias("c"), F.sum("raw").alias("n"), *(F.sum(p).alias(p) for p in names))

    def ratios(k: int) -> Column:
        good = lambda x: x["p0"] - x[f"p{k}"] if k else x["p0"]
        return F.transform("c", lambda x: F.round(UNIT * (F.log((good(x) + 1) / (good(row) + buckets)) - F.log((x["raw"] + 1) / (F.col("n") + buckets)))).cast("int"))

    return row.select(F.array(*map(ratios, range(PARTS + 1))).alias("llr"), F.col("p0").alias("g"))


def ratios_of(docs: DataFrame, *, text: str, part: str, buckets: int) -> list[list[int]]:
    """The ratios by part and bucket, fetched to the driver: ``buckets`` numbers a part, whatever the corpus. docs: of with_parts()."""
    row = model(docs, text=text, part=part, buckets=buckets).first()
    return row["llr"] if row["g"] else [[0] * buckets] * (PARTS + 1)


def fit_parts(docs: DataFrame, labels: DataFrame, *, text: str, key: str, buckets: int, max_trusted: int | None = None) -> tuple[list[list[int]], DataFrame]:
    """The ratios by part and bucket; and the trusted keys: all of them, unless max_trusted is given."""
    keys, part = label_keys(labels, key, max_trusted), free_name(docs, "__part")
    return ratios_of(with_parts(docs, keys, key=key, part=part), text=text, part=part, buckets=buckets), keys.where("good").select(key)


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, max_trusted: int | None = None) -> list[int]:
    """The ratio by bucket. labels: key, quality and toxic; trusted are quality 1, toxic 0. Where no trusted row is in docs, all ratios are 0."""
    return fit_parts(docs, labels, text=text, key=key, buckets=buckets, max_trusted=max_trusted)[0][0]


def threshold_between(clean: list[float], bad: list[float]) -> float:
    """The middle between the least score of the clean ones that have to stay (all but MAX_LOSS of them) and the best bad one under it. threshold_of() finds the same for tables."""
    if not clean:
        return THRESHOLD
    least = sorted(clean)[int(MAX_LOSS * len(clean))]
    return (max((x for x in bad if x < least), default=least) + least) / 2


def at_rank(rows: DataFrame, x: str, k: int) -> float:
    """The number that k others of column x go before in order, exactly: rows are counted in BINS bins of equal width, then those of the bin that holds it, until a bin has one value."""
    low, high = rows.agg(F.min(x), F.max(x)).first()
    while low < high:
        scale = (BINS - 1) / (high - low)
        inner = rows.where(F.col(x).between(low, high)).groupBy(F.floor((F.col(x) - low) * scale).alias("bin"))
        for _, n, low, high in inner.agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("bin").collect():
            if k < n:
                break
            k -= n
    return low


def threshold_of(rows: DataFrame, *, part: str, held: str) -> float:
    """The threshold by all labelled rows that pass the rules: trusted ones, each scored without its part, and bad ones, which no part has. rows: of judge() with parts."""
    rows = rows.where("NOT base_failed")
    clean, bad = rows.where(F.col(part) > 0), rows.where(F.col(part) == 0)
    n = clean.count()
    if not n:
        return THRESHOLD
    least = at_rank(clean, held, int(MAX_LOSS * n))
    best = bad.where(F.col("llr") < least).agg(F.max("llr")).first()[0]
    return ((least if best is None else best) + least) / 2


def verdict(failed: Column, llr: Column, threshold: float) -> Column:
    return ~failed & (F.coalesce(llr, F.lit(0.0)) >= threshold)


def judge(docs: DataFrame, ratios: list[int], *, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, part: str | None = None, held: str = "held") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr (null without words), base_failed and kept.

    Null and empty texts have no words and fail; every row is judged by itself, so repeated rows and ties are judged alike. Columns of
    these names in docs are replaced; others stay. With part, ratios are those of all parts in turn, the column is with_parts()'s, and
    held is a trusted row's score by the model without its part.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    table = lambda r: F.split(F.lit(",".join(map(str, r))), ",").cast("array<int>")  # noqa: E731, folded to one literal when the plan is made
    h, g, tri, order = (free_name(docs, x) for x in ("__h", "__g", "__tri", "__order"))
    buckets = len(ratios) // (PARTS + 1 if part else 1)
    d = docs.withColumn(h, hashes(F.col(text)))
    plain = t
    for c in " \t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    ln = free_name(docs, "__lines")
    d = d.withColumn(g, grams(F.col(h), buckets)).withColumn(tri, windows(F.col(h))).withColumn(ln, lines).withColumn(order, in_order(F.col(tri)))
    n = F.size(h)
    score = lambda r, at: F.aggregate(F.col(g), F.lit(0).cast("long"), lambda a, b: a + F.get(table(r), at(b))) / F.size(g) / UNIT
    out = {
        "n_words": n.cast("long"),
        "word_chars": F.length(plain).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        "n_repeat_words": F.when(F.col(order).isNull(), F.lit(0)).otherwise(covered(F.col(order))).cast("long"),
        "llr": F.when(n > 0, score(ratios[:buckets], lambda b: b)),
    }
    if part:
        out[held] = F.when((n > 0) & (F.col(part) > 0), score(ratios[buckets:], lambda b: b + (F.col(part) - 1) * buckets))
    names = [*out, "base_failed", "kept"]
    told = d.select(*(c for c in docs.columns if c not in names), *(c.alias(f"{h}_{n}") for n, c in out.items()))
    v = {n: F.col(f"{h}_{n}") for n in out}
    failed = (v["n_words"] < MIN_WORDS) | (100 * v["n_repeat_words"] > 50 * v["n_words"])
    row = F.struct(*(c.alias(n) for n, c in v.items()), failed.alias("base_failed"), verdict(failed, v["llr"], threshold).alias("kept"))
    # a generator of one row, so that filters on these columns stay above: pushed below, they would work out the arrays again for each element
    return told.select(*(c for c in docs.columns if c not in names), F.inline(F.array(row)))


def rate(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float | None = None, carry: list[str] | None = None) -> DataFrame:
    """judge() for all of docs by the model over all of them and all labels. carry: the columns of docs to keep, all if not given.

    The threshold, unless given, comes from all labelled rows: every row is judged once and stored, with its held-out score if trusted, then the threshold is found
    and applied to what is stored. So carried columns have to be of types that Parquet holds.
    """
    carry = docs.columns if carry is None else carry
    part, held = free_name(docs, "__part"), free_name(docs, "__held")
    d = with_parts(docs, label_keys(labels, key), key=key, part=part)
    parts = ratios_of(d, text=text, part=part, buckets=BUCKETS)
    if threshold is not None:
        d = judge(docs, parts[0], text=text, key=key, threshold=threshold)
        return d.select(*(c for c in d.columns if c in carry or c in JUDGED))
    d = judge(d, [x for p in parts for x in p], text=text, key=key, part=part, held=held)
    d = stored(d.select(*(c for c in d.columns if c in carry or c in JUDGED or c not in docs.columns)))
    threshold = threshold_of(d, part=part, held=held)
    return d.withColumn("kept", verdict(F.col("base_failed"), F.col("llr"), threshold)).drop(part, held)
