"""Inverted index with positions as a written table, prefix look-up in it, and cover density.

The index holds one row a word and document with the word's places, partitioned by the first character of the word and sorted by word and
document, so a query for some prefixes opens the folders of those prefixes only and, in them, the row groups of those words.

Cover density: a cover is a run of places that holds all of the query's terms which the document has, and no smaller such run. A cover of up to ``SPAN``
words weighs 1, a longer one SPAN / length; the density is r / (r + 1) of the covers' sum r. Weights are whole millionths, so sums do not
depend on their order.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches, tidy
from sparkloom.operators.numbering import spread, written
from sparkloom.operators.retrieval import words
from sparkloom.session import shared_folder

LEAD, SPAN, UNIT = 1, 16, 1_000_000
#: Words that are inverted at a time; one text may have more.
SLICE_WORDS = 1 << 18


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """lead, word, key, places (ascending, from 0) of every word of every document; words are cut in the JVM and inverted by document in its task."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, i = np.cumsum(pc.list_value_length(b.column("w")).to_numpy(zero_copy_only=False)), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_WORDS, "right")))
                yield b.slice(i, j - i)
                i = j

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists = b.column("w").cast(pa.large_list(pa.large_string()))
            coded = lists.flatten().dictionary_encode()
            code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            sizes = np.diff(lists.offsets.to_numpy())  # of the slice
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((code, row))  # stable: places stay in order
            code, row, place = code[order], row[order], place[order]
            first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])]) if len(code) else np.zeros(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(code)].astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code[first])).cast(pa.string()), b.column("key").take(pa.array(row[first])), places], names=["word", "key", "places"])

    kind = docs.schema[key].dataType.simpleString()
    cut = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    small_batches(docs.sparkSession)
    return cut.mapInArrow(tidy(rows), f"word string, key {kind}, places array<int>").select(F.left("word", F.lit(LEAD)).alias("lead"), "word", "key", "places")


def write_index(docs: DataFrame, key: str, path: str, text: str = "text", parts: int | None = None) -> None:
    """Ranges of (word, document), so a word that all documents have is dealt over several tasks and files.

    Texts are read once: their postings are written as they come, and laid out from there. Few large files are dealt over the tasks first.
    """
    n = parts or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    raw = written(postings(spread(docs.select(key, text)), key, text), "postings-raw")
    raw.repartitionByRange(n, "lead", "word", "key").sortWithinPartitions("lead", "word", "key").write.partitionBy("lead").parquet(path)


def index_of(spark: SparkSession, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The index of a table of files, from the shared folder; made there if it is missing or the files have changed since."""
    conf = spark._jsc.hadoopConfiguration()
    digest = hashlib.sha256(f"2|{LEAD}|{key}|{text}".encode())
    for f in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        state = path.getFileSystem(conf).getFileStatus(path)
        digest.update(f"|{f}|{state.getLen()}|{state.getModificationTime()}".encode())
    target = f"{shared_folder(spark)}/postings-{digest.hexdigest()[:24]}"
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = place.getFileSystem(conf)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")):
        own = f"{target}-{uuid.uuid4().hex[:8]}"
        write_index(docs, key, own, text)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(own), place):  # another session was first
            target = own if not fs.exists(place) else target
    kind = docs.schema[key].dataType.simpleString()
    return spark.read.schema(f"word string, key {kind}, places array<int>, lead string").parquet(target)


def found(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """word, key, places, terms (numbers of the terms that the word begins with): only postings of the terms are read."""
    if not terms:
        return index.limit(0).select("word", "key", "places", F.array().cast("array<int>").alias("terms"))
    own = lambda t: (F.col("lead") == t[:LEAD] if len(t) >= LEAD else F.col("lead").startswith(t)) & F.col("word").startswith(t)
    some = reduce(lambda a, b: a | b, [own(t) for t in terms])
    which = F.array_compact(F.array(*[F.when(F.col("word").startswith(t), F.lit(i)) for i, t in enumerate(terms)]))
    return index.where(some).select("word", "key", "places", which.alias("terms"))


def cover_sum(events: Column, matched: Column, n: int, span: int = SPAN) -> Column:
    """Sum of the covers' weights, in millionths, by one sweep over ``events`` (place, terms), ascending by place.

    ``last`` has the last place of each term so far; the smallest of them begins the run that ends here. It is a cover if it begins behind the one before.
    """
    none, unseen = (1 << 31) - 1, -1
    last = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.array_contains(matched, i), F.lit(unseen)).otherwise(F.lit(none)))
    start = F.struct(last.alias("last"), F.lit(-1).alias("begin"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, e: Column) -> Column:
        now = F.transform(acc["last"], lambda x, i: F.when(F.array_contains(e["terms"], i), e["place"]).otherwise(x))
        # bound once by a one-element array: the new places and where the run begins
        return F.element_at(F.transform(F.array(F.struct(now.alias("last"), F.array_min(now).alias("at"))), lambda s: _joined(acc, e, s)), 1)

    def _joined(acc: Column, e: Column, s: Column) -> Column:
        new = s["at"] > acc["begin"]
        size = e["place"] - s["at"] + 1
        weight = F.when(size <= span, F.lit(UNIT)).otherwise(F.floor(F.lit(span * UNIT) / size)).cast("long")
        return F.struct(s["last"].alias("last"), F.when(new, s["at"]).otherwise(acc["begin"]).alias("begin"), (acc["sum"] + F.when(new, weight).otherwise(F.lit(0).cast("long"))).alias("sum"))

    return F.aggregate(events, start, step, lambda acc: acc["sum"])


def scores(index: DataFrame, key: str, terms: Sequence[str], span: int = SPAN) -> DataFrame:
    """key, matched (terms), tf (hits), covers (millionths) and density of every document with a word that begins with a term. No terms: no rows."""
    rows = found(index, terms).groupBy("key").agg(F.collect_list(F.struct("terms", "places")).alias("_p"))
    events = F.array_sort(F.flatten(F.transform("_p", lambda p: F.transform(p["places"], lambda x: F.struct(x.alias("place"), p["terms"].alias("terms"))))))
    matched = F.array_distinct(F.flatten(F.transform("_p", lambda p: p["terms"])))
    tf = F.aggregate("_p", F.lit(0), lambda s, p: s + F.size(p["places"]) * F.size(p["terms"]))
    told = rows.select(F.col("key").alias(key), matched.alias("_m"), events.alias("_e"), tf.alias("tf"))
    told = told.select(key, F.size("_m").alias("matched"), "tf", cover_sum(F.col("_e"), F.col("_m"), max(1, len(terms)), span).alias("covers"))
    return told.withColumn("density", F.round(F.col("covers") / (F.col("covers") + UNIT), 6))
