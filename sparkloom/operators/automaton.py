"""Dictionaries as Aho-Corasick automata: one pass over a text finds all terms, however many there are.

A dictionary is measured first. Up to ``BLOCK`` characters it is one automaton, which is broadcast as its terms and built once a worker; more
characters make several blocks, up to ``BLOCKS``, and one pass over the texts for each. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.numbering import spread

BLOCK, BLOCKS = 2_000_000, 8
_BUILT: dict[str, tuple] = {}


def automaton(terms: Sequence[str]):
    """Automaton whose values are the numbers of the terms; None without terms."""
    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        if t:
            a.add_word(t, i)
    if not len(a):
        return None
    a.make_automaton()
    return a


def built(token: str, terms: list[str]) -> tuple:
    """Automaton, empty terms, sizes and names of a dictionary; a worker keeps the last one."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = (automaton(terms), [i for i, t in enumerate(terms) if not t], [len(t) for t in terms], pa.array(terms, pa.string()))
    return _BUILT[token]


def term_blocks(terms: DataFrame, term: str, block: int = BLOCK, most: int = BLOCKS) -> list[list[str]] | None:
    """The distinct terms in blocks of about ``block`` characters at most; None if there would be more than ``most``."""
    distinct = terms.select(F.col(term).alias("t")).where("t IS NOT NULL").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("t") + 1), F.lit(0))).first()[0]  # one more, so that empty terms count
    n = max(1, -(-size // block))
    if n > most:
        return None
    out: list[list[str]] = [[] for _ in range(n)]
    for t, k in distinct.select("t", F.pmod(F.xxhash64("t"), F.lit(n))).collect():  # at most ``most`` x ``block`` characters
        out[k].append(t)
    return [sorted(x) for x in out]


def first_places(spark, terms: list[str]):
    """Column function text -> array of (term, at): each term that lies in the text, with its first place there (from 1)."""
    sent, token = spark.sparkContext.broadcast(terms), uuid.uuid4().hex

    @F.arrow_udf("array<struct<term:string,at:int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto, empty, sizes, names = built(token, sent.value)
        for texts in batches:
            which, where, upto = [], [], [0]
            for text in texts.to_pylist():
                if text is not None:
                    first = dict.fromkeys(empty, 1)
                    if auto is not None:
                        for end, i in auto.iter(text):
                            if i not in first:
                                first[i] = end - sizes[i] + 2
                    which += first.keys()
                    where += first.values()
                upto.append(len(which))
            pairs = pa.StructArray.from_arrays([names.take(pa.array(which, pa.int64())), pa.array(where, pa.int32())], names=["term", "at"])
            yield pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pairs)

    return find


def hits(texts: DataFrame, terms: DataFrame, blocks: list[list[str]]) -> DataFrame:
    """Pairs of rows where ``text_norm`` contains ``term_norm``, with its first place ``at``. ``blocks`` hold the terms."""
    texts, out = spread(texts), None
    for own in blocks:
        found = texts.withColumn("_h", F.explode(first_places(texts.sparkSession, own)(F.col("text_norm"))))
        found = found.select(*texts.columns, F.col("_h.term").alias("term_norm"), F.col("_h.at").alias("at"))
        out = found if out is None else out.unionByName(found)
    named = F.broadcast(terms) if len(blocks) == 1 else terms  # a block's characters bound its rows
    return out.join(named, "term_norm").select(*texts.columns, *terms.columns, "at")


# ---------------------------------------------------------------- spans


@functools.lru_cache(1 << 16)
def fold(s: str) -> str:
    return "".join(unicodedata.normalize("NFKC", s).lower().split())


def folded(text: str) -> tuple[str, list[int], bool]:
    """The text folded character by character, the raw place of each folded one, and whether folding the whole gives the same."""
    if text.isascii():
        where = [i for i, c in enumerate(text) if not c.isspace()]
        return "".join(text.lower().split()), where, True
    chars, where = [], []
    for i, c in enumerate(text):
        x = fold(c)
        chars.append(x)
        where += [i] * len(x)
    n = "".join(chars)
    return n, where, n == "".join(unicodedata.normalize("NFKC", text).lower().split())


def inside_word(text: str, a: int, b: int) -> bool:
    """Whether the span begins within a word and runs over white space."""
    if not any(c.isspace() for c in text[a:b]):
        return False
    before = next((c for c in reversed(text[:a]) if c.isspace() or c.isalnum()), " ")
    return not before.isspace()


def spans(text: str, auto, sizes: Sequence[int]) -> dict[int, tuple[int | None, int | None]]:
    """Of each term its first admissible raw span; (None, None) for terms in a text whose folding by character differs from that of the whole.

    A term of at most two folded characters is not admissible where it begins within a word and runs over white space.
    """
    if auto is None:
        return {}
    n, where, same = folded(text)
    if not same:
        whole = "".join(unicodedata.normalize("NFKC", text).lower().split())
        return {i: (None, None) for _, own in auto.iter(whole) for i in own}
    out: dict[int, tuple[int | None, int | None]] = {}
    for end, own in auto.iter(n):
        for i in own:
            if i not in out:
                a, b = where[end - sizes[i] + 1], where[end] + 1
                if sizes[i] > 2 or not inside_word(text, a, b):
                    out[i] = (a, b)
    return out


def spans_of(terms: Sequence[str]) -> tuple:
    """Automaton over the folded terms, whose values are the numbers of the terms that fold to it, and the folded lengths."""
    keys = [fold(t) for t in terms]
    by: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        if k:
            by.setdefault(k, []).append(i)
    a = ahocorasick.Automaton()
    for k, own in by.items():
        a.add_word(k, own)
    if by:
        a.make_automaton()
    return (a if by else None), [len(k) for k in keys]


def spans_udf(terms: Sequence[str]):
    """Column function text -> array of (term, start, end), in the order of the terms, in one pass over the text."""
    terms = list(terms)

    @F.arrow_udf("array<struct<term:string,start:int,end:int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto, sizes = spans_of(terms)
        names = pa.array(terms, pa.string())
        for texts in batches:
            which, at, upto = [], [], [0]
            for text in texts.to_pylist():
                got = sorted(spans(text or "", auto, sizes).items())
                which += [i for i, _ in got]
                at += [x for _, x in got]
                upto.append(len(which))
            cols = [pa.array([x[k] for x in at], pa.int32()) for k in (0, 1)]
            yield pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([names.take(pa.array(which, pa.int64())), *cols], names=["term", "start", "end"]))

    return find


# ---------------------------------------------------------------- phrases of a group in the texts of that group


#: Phrases, and characters of texts, that meet in one step; larger groups are dealt over several.
PHRASES, CHARS, FEW = 20_000, 8_000_000, 16


def _meet(kinds: list[pa.DataType]):
    """For mapInArrow over (group, block, chunk, phrase, text, mark), sorted so that phrases of a key stand first: (group, phrase, mark) of each text with a phrase."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, phrases, auto, out = None, [], None, []
        for b in batches:
            for g, block, chunk, phrase, text, mark in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if (g, block, chunk) != key:
                    key, phrases, auto = (g, block, chunk), [], None
                if phrase is not None:
                    phrases.append(phrase)
                elif len(phrases) <= FEW:
                    out += [(g, p, mark) for p in phrases if p in text]
                else:
                    auto = auto or automaton(phrases)
                    out += [(g, phrases[i], mark) for i in {i for _, i in auto.iter(text)}]
            if len(out) >= 2000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["g", "phrase", "mark"])

    return rows


def phrases_in(phrases: DataFrame, texts: DataFrame, group: str, many: int = PHRASES, chars: int = CHARS) -> DataFrame:
    """g, phrase, mark for each phrase (``group``, phrase; distinct, not empty) and each text (``group``, text, mark) of its group that contains it.

    A group meets in one place, unless it has more than ``many`` phrases or ``chars`` characters: then its phrases are dealt into blocks and its texts into chunks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    p = phrases.groupBy(group).agg(F.ceil(F.count("*") / many).cast("int").alias("_blocks"))
    t = texts.groupBy(group).agg(F.ceil(F.sum(F.length("text") + 1) / chars).cast("int").alias("_chunks"))
    large = F.broadcast(p.join(t, group).where("_blocks > 1 OR _chunks > 1"))  # at most a row for each ``many`` phrases or ``chars`` characters
    one = lambda c: F.coalesce(c, F.lit(1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), one(F.col(n))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), one(F.col(n)) - 1))
    none = F.lit(None).cast("string")
    left = phrases.join(large, group, "left").select(F.col(group).alias("g"), deal("phrase", "_blocks").alias("block"), each("_chunks").alias("chunk"), "phrase", none.alias("text"), F.lit(None).cast(texts.schema["mark"].dataType).alias("mark"))
    right = texts.join(large, group, "left").select(F.col(group).alias("g"), each("_blocks").alias("block"), deal("text", "_chunks").alias("chunk"), none.alias("phrase"), "text", "mark")
    keys: list[Column] = [F.col(c) for c in ("g", "block", "chunk")]
    met = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, F.desc_nulls_last("phrase"))
    kind = phrases.schema[group].dataType
    mark = texts.schema["mark"].dataType
    return met.mapInArrow(_meet([to_arrow_type(kind), pa.string(), to_arrow_type(mark)]), f"g {kind.simpleString()}, phrase string, mark {mark.simpleString()}")
