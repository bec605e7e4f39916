"""Quality rules: counted facts of each text, then a log-likelihood ratio of hashed n-grams.

Two multinomials over `BUCKETS` hash buckets are counted in Spark: one over all documents (the raw
corpus), one over trusted documents. A text's score is the mean of log(p_trusted / p_raw) over its
n-grams, and it is kept if the score reaches a fixed threshold. Only DataFrame functions run here.

Each word gives two n-grams: itself, lower-cased, and the pair of its shape and the next word's (the
last word's with nothing). A shape has `a` for every run of letters and digits and all else as it
stands. So the score sees vocabulary as well as layout and symbols.

Defined results: null text counts as empty; a text without words has zero counts, score 0 and fails
the base rules; without trusted documents every score is 0 and the base rules alone decide. Repeated
doc_ids give one row each. Further columns are ignored by `judge` and kept by `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import SPACES, computed_once, split_words, whole_text

#: Size of both multinomials; the weights are one array of so many doubles.
BUCKETS = 1 << 13
#: At most so many trusted documents are used, the first by hash of doc_id; all documents are
#: counted for the raw corpus.
TRUSTED_ROWS = 10_000
#: Texts whose mean log ratio is below this are rejected.
THRESHOLD = -0.3
#: Added to every bucket's count.
SMOOTHING = 1.0

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _bucket(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(BUCKETS - 1).cast("int")


def _split(docs: DataFrame, keep: list[str], **more: Column) -> DataFrame:
    """Words, and their shapes: as many, as no space is a letter or a digit."""
    text = whole_text()
    shapes = split_words(F.regexp_replace(text, r"[\p{L}\p{N}]+", "a"))
    return computed_once(docs, keep, _words=split_words(text), _shapes=shapes, **more)


def weights(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """One row, `weights`: log(p_trusted / p_raw) per bucket, from counts over all documents."""
    first = (
        trusted_ids.where(F.col("doc_id").isNotNull())
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRUSTED_ROWS)
        .withColumn("_trusted", F.lit(1))
    )
    marked = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id", "left")
    split = _split(marked, ["_trusted"])
    # one row per word, with what follows it, so that hashing runs in generated code
    following = F.slice("_shapes", 2, F.greatest(F.size("_shapes"), F.lit(1)))
    words = split.withColumn("_next", following).select(
        "_trusted", F.inline(F.arrays_zip("_words", "_shapes", "_next"))
    )
    grams = F.array(_bucket(F.lower("_words")), _bucket("_shapes", F.coalesce("_next", F.lit(""))))
    counts = (
        words.select("_trusted", F.explode(grams).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("_trusted").alias("good"))
    )
    filled = (
        docs.sparkSession.range(BUCKETS)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(counts, "bucket", "left")
        .select(
            "bucket",
            F.coalesce("raw", F.lit(0)).alias("raw"),
            F.coalesce("good", F.lit(0)).alias("good"),
        )
    )
    # one group of exactly BUCKETS rows
    total = filled.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("rows"),
        F.sum("raw").alias("n_raw"),
        F.sum("good").alias("n_good"),
    )
    base = F.log(
        (F.col("n_raw") + SMOOTHING * BUCKETS) / (F.col("n_good") + SMOOTHING * BUCKETS)
    )
    return total.select(
        F.transform(
            "rows",
            lambda r: F.when(
                F.col("n_good") > 0, F.log((r["good"] + SMOOTHING) / (r["raw"] + SMOOTHING)) + base
            ).otherwise(0.0),
        ).alias("weights")
    )


#: Low bits of a packed window for its position; a text of more words is beyond a row's 2 GB.
_PLACE_BITS = 28


def _window_places(words: Column, n: Column) -> Column:
    """Hash bits and position of every 3-word window in one long each, sorted."""
    starts = F.sequence(F.lit(0), n - 3)
    packed = F.transform(
        starts,
        lambda i: F.shiftleft(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), _PLACE_BITS
        ).bitwiseOR(i.cast("long")),
    )
    return F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<long>"))


def _same_hash(x: Column, y: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS) == F.shiftright(y, _PLACE_BITS)


def _repeated(windows: Column, words: Column) -> Column:
    """Positions of windows that stand twice or more: equal hashes first, then equal words."""
    likely = F.filter(
        windows,
        lambda x, i: _same_hash(x, F.get(windows, i - 1)) | _same_hash(x, F.get(windows, i + 1)),
    )
    return F.transform(
        likely,
        lambda x: F.struct(
            F.array_join(
                F.slice(words, x.bitwiseAND((1 << _PLACE_BITS) - 1).cast("int") + 1, 3), " "
            ).alias("window"),
            x.bitwiseAND((1 << _PLACE_BITS) - 1).cast("int").alias("p"),
        ),
    )


def _judged(docs: DataFrame, trusted_ids: DataFrame, threshold: float) -> DataFrame:
    """The rows of `docs` as struct `_row`, and beside it all that is found out about each."""
    table = weights(docs.select("doc_id", "text"), trusted_ids).scalar()
    text = whole_text()
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    split = _split(
        docs.select("text", F.struct("*").alias("_row")),
        ["_row"],
        _weights=table,
        _lines=lines,
        n_symbols=F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
    )
    words, shapes, n = F.col("_words"), F.col("_shapes"), F.size("_words")
    table = F.col("_weights")
    weighed = F.transform(
        words,
        lambda w, i: F.get(table, _bucket(F.lower(w)))
        + F.get(table, _bucket(F.get(shapes, i), F.coalesce(F.get(shapes, i + 1), F.lit("")))),
    )
    sums = F.aggregate(weighed, F.lit(0.0), lambda total, x: total + x)
    facts = computed_once(
        split,
        ["_row", "_words", "n_symbols"],
        n_words=n.cast("long"),
        word_chars=F.length(F.array_join(words, "")).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        score=F.when(n > 0, sums / (2 * n)).otherwise(0.0),
        _windows=_window_places(words, n),
    )
    found = ["_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "score"]
    likely = computed_once(facts, found, _likely=F.array_sort(_repeated(F.col("_windows"), words)))
    again = F.col("_likely")
    places = computed_once(
        likely,
        found,
        _at=F.sort_array(
            F.transform(
                F.filter(
                    again,
                    lambda x, i: (x["window"] == F.get(again, i - 1)["window"])
                    | (x["window"] == F.get(again, i + 1)["window"]),
                ),
                lambda x: x["p"],
            )
        ),
    )
    # each repeated window covers three words, less what the next one covers itself
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        places.withColumn("n_repeat_words", covered)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .drop("_at")
    )


def judge(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, the counted facts, `score`, `base_failed` and `kept`."""
    found = _judged(docs.select("doc_id", "text"), trusted_ids, threshold)
    return found.select("_row.doc_id", *[c for c in found.columns if c != "_row"])


def keep(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that `judge` keeps, with all their columns."""
    return _judged(docs, trusted_ids, threshold).where("kept").select("_row.*")


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
