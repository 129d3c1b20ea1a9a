"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Two
multinomials over the buckets are estimated with add-``ALPHA`` smoothing: one from
trusted documents, one from every document, whose counts are first scaled to the
trusted total. A bucket that is rare in the corpus then gives hardly any evidence
(its log ratio is near 0), so clean documents outside the trusted set are not
marked down for words of their own. A document's score is the mean over
its features of log(target / raw), so length does not matter, and every document
is decided by one fixed threshold instead of by sampling. Beside it stand counting
rules on the text itself.

Everything is DataFrame expressions. Raw counts cover all documents; trusted
documents are a bounded set of labelled ids (``max_trusted``, taken in hash order),
small enough to mark documents by a broadcast. The model is a table of ``BUCKETS``
rows, broadcast to the exploded features.

Defined cases: a null text has no words; a document without words scores 0 and
fails the base rules; repeated rows are judged alike; an empty table or a table
without labels gives scores of 0 (no evidence); extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundia.llm.common import SPACES, id_or_least, saved

BUCKETS = 1 << 18
MAX_TRUSTED = 100_000
ALPHA = 4.0
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.15
MIN_WORDS = 20
WINDOW = 8
BLANK = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _joined(hashes: Column, gap: int) -> Column:
    """Each hash with the one ``gap`` places on; the last ones have none and stand for themselves."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + gap)))


def _features(hashes: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours; the first word also pairs with the text's start."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    single = F.transform(hashes, lambda h: bucket(h))
    return F.concat(single, F.transform(hashes, lambda h, i: bucket(F.xxhash64(F.get(hashes, i - 1), h))))


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """Ids of trusted documents: at most ``most``, in hash order."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def model(docs: DataFrame, trusted: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(bucket, weight): the log ratio of every bucket, ``BUCKETS`` rows."""
    mine = F.broadcast(trusted.select(F.col("doc_id").alias("t_id")).withColumn("t", F.lit(1)))
    words = docs.select(F.col("doc_id").cast("long").alias("d_id"), _hashes(F.coalesce("text", F.lit(""))).alias("hashes"))
    marked = words.join(mine, F.col("d_id") == F.col("t_id"), "left").select("hashes", F.coalesce("t", F.lit(0)).alias("t"))
    found = marked.select("t", F.explode(_features(F.col("hashes"))).alias("bucket"))
    counts = saved(found.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")))
    all_raw, all_target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    dense = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    share = all_target / all_raw if all_raw else 0.0
    ratio = F.log((F.col("target") + alpha) / (F.col("raw") * share + alpha))
    return saved(dense.select("bucket", (ratio if all_target else F.lit(0.0)).alias("weight")))


def _covered(positions: Column) -> Column:
    """Words in the union of windows that start at sorted ``positions``."""
    gaps = F.transform(positions, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, j + 1) - p, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, word hashes and the counts of the base rules, a row for each row of ``docs``."""
    text = F.col("text")
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    step = step.withColumn("words", _words(text)).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    step = step.withColumn("n_words", F.size("hashes").cast("long"))
    # a window is four words and the four behind them; without equal fours there are no equal windows
    step = step.withColumn("twos", _joined(F.col("hashes"), 1))
    step = step.withColumn("fours", _joined(F.col("twos"), 2))
    equal = (F.col("n_words") >= WINDOW) & (F.size(F.array_distinct("fours")) < F.size("fours"))
    starts = F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))
    step = step.withColumn("windows", F.when(equal, F.slice(_joined(F.col("fours"), WINDOW // 2), F.lit(1), starts)))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("placed", F.when(repeats, placed))
    at = F.col("placed")

    def twice(x: Column, j: Column) -> Column:
        return F.coalesce(F.get(at, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(at, j + 1)["h"] == x["h"], F.lit(False))

    step = step.withColumn("twice", F.sort_array(F.transform(F.filter(at, twice), lambda x: x["i"])))
    step = step.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    repeated = F.when(F.col("twice").isNotNull(), _covered(F.col("twice"))).otherwise(F.lit(0))
    return step.select(
        "doc_id",
        F.xxhash64(text).alias("text_key"),
        "hashes",
        "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.octet_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )


def judge(docs: DataFrame, weights: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, the counts, base_failed, kept and the score ``llr``, a row for each row of ``docs``.

    The features of a row stay in one partition until they are summed, so one
    row per document is shuffled.
    """
    key = ["row", "doc_id", "text_key", *COUNTS]
    rows = counted(docs).withColumn("row", F.monotonically_increasing_id())
    found = rows.select(*key, F.explode_outer(_features(F.col("hashes"))).alias("bucket"))
    scored = found.join(F.broadcast(weights), "bucket", "left").groupBy(*key).agg(F.coalesce(F.avg("weight"), F.lit(0.0)).alias("llr"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = scored.drop("row").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts and the verdict of every document."""
    return judge(docs, model(docs, trusted_ids(labels)), threshold).drop("text_key")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged. A verdict depends on the text alone, so it is found again by id and text."""
    judged = judge(docs, model(docs, trusted_ids(labels)), threshold)
    gone = judged.where(~F.col("kept")).select(id_or_least().alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    # the row travels as one column, so no name of its own can clash
    keyed = docs.select(
        F.struct("*").alias("row"), id_or_least().alias("gone_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("gone_key")
    )
    return keyed.join(gone, ["gone_id", "gone_key"], "left_anti").select("row.*")
