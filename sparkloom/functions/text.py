"""Text expressions. All are Column expressions that stay in the JVM unless the name ends in ``_udf``.

Word lists are our own small neutral ones for the languages of the test tables.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators that count as one in matching.
SEPARATORS = "·•‧∙・|/;"
INVISIBLE = "​‌‍⁠﻿­"
#: Words whose spelling with separators between the letters counts as evasion.
GUARDED = ("free", "pills", "win")
CHUNK = 700
#: Blanks of Unicode (category Zs), which sentences are trimmed of.
BLANKS = " \u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"


def sep_norm(text: Column) -> Column:
    """All list separators become the middle dot."""
    return F.translate(text, SEPARATORS, "·" * len(SEPARATORS))


def match_norm(text: Column) -> Column:
    """Matching form: white space removed, lower case."""
    return F.lower(F.regexp_replace(text, r"[ \t\r\n]+", ""))


def evasion_flags(text: Column) -> Column:
    """Names of the evasions that the raw text shows, in a fixed order."""
    spaced = "|".join("[-.*_ ]".join(w) for w in GUARDED)
    flags = F.array(
        F.when(text.rlike(f"[{INVISIBLE}]"), "invisible"), F.when(F.lower(text).rlike(spaced), "spaced_word"),
        F.when(text.rlike(r"[!?]{2,}"), "marks"), F.when(text.rlike(r"[%&#$*]{3,}"), "symbols"),
    )
    return F.array_compact(flags)


def redact(text: Column) -> Column:
    """E-mail addresses, long digit groups and key-like tokens give way to marks."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "[email]")
    out = F.regexp_replace(out, r"\+?[0-9][0-9() .-]{7,}[0-9]", "[number]")
    return F.regexp_replace(out, r"(sk|AKIA|ghp)[-_A-Za-z0-9]{12,}", "[key]")


def fingerprint(text: Column) -> Column:
    """Length and the first 8 hex digits of the SHA-256."""
    return F.concat(F.length(text).cast("string"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 8))


def residue(text: Column, names: Sequence[str]) -> Column:
    """How many of the names are left in a masked text."""
    return F.size(F.regexp_extract_all(text, F.lit("(" + "|".join(names) + ")"), F.lit(1)))


def mask_anchors(text: Column, names: Sequence[str], mark: str = "[org]") -> Column:
    """Longest name first, so a name inside another is not torn."""
    for n in sorted(names, key=lambda n: (-len(n), n)):
        text = F.replace(text, F.lit(n), F.lit(mark))
    return text


def sentences(text: Column) -> Column:
    """Boundaries: line feeds, and a blank behind a full stop, exclamation or question mark. Never empty: falls back to the whole."""
    parts = F.split(F.regexp_replace(text, r"([.!?])[ ]+", "$1\n"), "\n")
    # one argument: F.trim by itself would be given a part's number as what to trim
    kept = F.filter(F.transform(parts, lambda s: F.trim(s, F.lit(BLANKS))), lambda s: s != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(text))


# White space of Unicode; what ends a sentence; pictographs (blocks of symbols, dingbats, arrows, selectors, joiner).
SPACES = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
ENDS = r".!?\u3002\uFF01\uFF1F\u2026"
PICTOGRAPHS = "\U0001F000-\U0001FAFF" r"\u2600-\u27BF\u2B00-\u2BFF\uFE0F\u200D"  # as characters: look-behind then sees both halves of a pair


def copy_sentences(text: Column) -> Column:
    """Sentences of short copy, which often has no full stops: substrings of the text, trimmed of white space.

    Boundaries: line feeds; white space behind an end mark or a pictograph, or before a hashtag. Never empty: a text of white space only is its own
    sentence; null gives null. Runs of white space are looked at once, so the time is linear in the text.
    """
    run = f"(?<![{SPACES}])[{SPACES}]++"
    parts = F.split(text, f"\\n|(?<=[{ENDS}{PICTOGRAPHS}])[{SPACES}]++|{run}(?=#[^{SPACES}])")
    kept = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, f"\\A[{SPACES}]++|{run}\\z", "")), lambda p: p != "")
    return F.when(F.size(kept) > 0, kept).when(text.isNotNull(), F.array(text))


def hard_cut(text: Column, size: int = CHUNK) -> Column:
    """Pieces of at most ``size`` characters, cut in one pass; an empty text is one empty piece."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def piece_count(text: Column, size: int = CHUNK) -> Column:
    """How many pieces :func:`hard_cut` gives."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")


def pack_chunks(text: Column, size: int = CHUNK) -> Column:
    """Greedy packing of sentences into chunks of at most ``size``; a longer sentence is cut hard. Short texts stay whole."""
    parts = F.split(F.regexp_replace(text, r"\.[ ]", ".\n"), "\n")
    last = lambda acc: F.element_at(acc, -1)

    def add(acc, s):
        room = (F.size(acc) > 0) & (F.length(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) + F.length(s) + 1 <= size)
        return F.when(room, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last(acc), F.lit(" "), s)))).otherwise(F.concat(acc, F.array(s)))

    packed = F.aggregate(parts, F.array().cast("array<string>"), add)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.flatten(F.transform(packed, lambda c: hard_cut(c, size))))


def low_information(text: Column) -> Column:
    """Why a row carries no information, or null: deleted marks, few letters, a head without body."""
    solid = F.regexp_replace(text, r"\s+", "")
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}]+", ""))
    bare = F.regexp_replace(F.lower(text), r"deleted|[^a-z]+", "")
    return (
        F.when(F.lower(text).contains("deleted") & (bare == ""), "deleted")
        .when(letters / F.greatest(F.length(solid), F.lit(1)) < 0.25, "few_letters")
        .when((F.length(text) <= 40) & ~text.rlike("[.!?]"), "title_only")
    )


def first_rule(rules: Sequence[tuple[str, Column]], otherwise: str = "unknown") -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, holds in rules:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def clause_around(text: Column, at: Column) -> Column:
    """The clause (up to commas, semicolons, stops) around a 1-based position."""
    left = F.substring_index(F.regexp_replace(F.substring(text, F.lit(1), at - 1), "[,;.!?\n]", "\n"), "\n", -1)
    right = F.substring_index(F.regexp_replace(F.substring(text, at, F.length(text)), "[,;.!?\n]", "\n"), "\n", 1)
    return F.concat(left, right)


def last_word_suffix(text: Column, endings: Sequence[str]) -> Column:
    """The longest of the endings that the text's last word has, of 4 to 2 letters, or null."""
    word = F.lower(F.regexp_extract(text, r"(\p{L}+)[^\p{L}]*$", 1))
    out = F.lit(None).cast("string")
    for n in (2, 3, 4):
        known = [e for e in endings if len(e) == n]
        tail = F.substring(word, -n, n)
        out = F.when((F.length(word) >= n) & tail.isin(*known), tail).otherwise(out) if known else out
    return out


def embed_input(context: Column, text: Column) -> Column:
    """Context (where there is one) and text; fingerprinted by :func:`sha`."""
    return F.concat_ws("\n", F.when(context != "", context), text)


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


#: Families of quotation marks; a mark closes only what one of its own family opened.
QUOTES = ('"“”„', "'‘’‚", "«»")


def quoted(text: Column, least: int = 1, most: int = 200, families: Sequence[str] = QUOTES) -> Column:
    """Quoted spans of one line, family by family, duplicates kept, blanks collapsed, of ``least`` to ``most`` characters.

    What stands before a mark decides: no letter or digit before one that opens, no blank before one that closes. Hence a span is two marks
    of a family without another between them, and a mark that cannot close leaves the search to begin again at itself.
    """
    found = [F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{Nd}}])[{m}]([^{m}\n]*)(?<![\s\p{{Z}}])[{m}]"), F.lit(1)) for m in families]
    plain = F.transform(F.concat(*found), lambda q: F.trim(F.regexp_replace(q, r"[\s\p{Z}]+", " ")))
    return F.filter(plain, lambda q: F.length(q).between(least, most))


# ---------------------------------------------------------------- order-dependent kernels (Arrow batches)

NORMAL, RAW_WORD = "doc_id long, norm string, offset_map array<int>, rules array<string>", "doc_id long, k int, word string, raw_start int, raw_end int, raw string"


def normalise(raw: str) -> tuple[str, list[int], list[str]]:
    """(normalised text, raw offset of each of its characters, rules that fired in fixed order).

    Invisible characters go; each character is NFKC-normalised on its own; of runs of one character two stay (digits and
    blanks are exempt); blanks but for line feeds collapse to one space.
    """
    import unicodedata

    fired, pairs = set(), []
    for i, c in enumerate(raw):
        if c in INVISIBLE:
            fired.add("invisible")
            continue
        wide = unicodedata.normalize("NFKC", c)
        if wide != c:
            fired.add("width")
        pairs += [(x, i) for x in wide]
    out: list[tuple[str, int]] = []
    for c, i in pairs:
        if len(out) >= 2 and out[-1][0] == out[-2][0] == c and not c.isdigit() and not c.isspace():
            fired.add("repeat")
        elif c != "\n" and c.isspace():
            if out and out[-1][0] == " ":
                fired.add("space")
                continue
            if c != " ":
                fired.add("space")
            out.append((" ", i))
        else:
            out.append((c, i))
    return "".join(c for c, _ in out), [i for _, i in out], [r for r in ("invisible", "width", "repeat", "space") if r in fired]


def to_raw(offsets: Sequence[int], raw_length: int, start: int, end: int) -> tuple[int, int]:
    """Raw span of a span of the normalised text. Offsets ascend, so the raw character behind the span's last one is found by bisection,
    however many normalised characters that one gave."""

    def raw(k: int) -> int:
        return offsets[k] if k < len(offsets) else raw_length

    return raw(start), raw(bisect_right(offsets, offsets[end - 1])) if end > start else raw(start)


#: Rules of :func:`normalise` that tell of an attempt to hide a word; long runs and blanks do not.
EVASIONS = ("invisible", "width")


def evasions(rules: Column) -> Column:
    return F.filter(rules, lambda r: r.isin(*EVASIONS))


#: Characters of normalised texts, or words, in a batch that the kernels give; one text may have more.
BATCH_CHARS, BATCH_WORDS = 1 << 20, 20_000


def normalised_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, text): norm, offset_map and rules of each text. A text's lists end with it; only a batch of ``BATCH_CHARS`` is held, four bytes an offset."""

    def made(ids: list, norms: list[str], maps: list[np.ndarray], rules: list[list[str]]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, maps)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(maps)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(norms, pa.string()), lists, pa.array(rules, pa.list_(pa.string()))], names=["doc_id", "norm", "offset_map", "rules"])

    out, size = ([], [], [], []), 0
    for b in batches:
        for i, x in zip(b.column("doc_id"), b.column("text"), strict=True):
            norm, offsets, rules = normalise(x.as_py() or "")
            for c, v in zip(out, (i.as_py(), norm, np.array(offsets, np.int32), rules), strict=True):
                c.append(v)
            size += len(norm)
            if size >= BATCH_CHARS:
                yield made(*out)
                out, size = ([], [], [], []), 0
    if out[0]:
        yield made(*out)


def raw_word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, text): a row a word of the normalised text with its span in the raw one, ``BATCH_WORDS`` at a time."""
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "k", "word", "raw_start", "raw_end", "raw"])

    out: list[tuple] = []
    for b in batches:
        for i, x in zip(b.column("doc_id"), b.column("text"), strict=True):
            doc, text = i.as_py(), x.as_py() or ""
            norm, offsets, _ = normalise(text)
            for k, m in enumerate(re.finditer(r"\S+", norm)):
                a, z = to_raw(offsets, len(text), *m.span())
                out.append((doc, k, m[0], a, z, text[a:z]))
                if len(out) >= BATCH_WORDS:
                    yield made(out)
                    out = []
    if out:
        yield made(out)


def offsets_of(text: str, parts: Sequence[str]) -> list[int]:
    """Start of each part, each searched from the end of the one before; raises if a part is not there."""
    out, at = [], 0
    for p in parts:
        i = text.find(p, at)
        if i < 0:
            raise ValueError("a part does not occur in the text")
        out.append(i)
        at = i + len(p)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def offsets_udf(texts: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([offsets_of(t or "", list(p)) for t, p in zip(texts, parts, strict=True)])


def split_claims(text: str, dot: str = "·") -> list[str]:
    """Split at the dot outside brackets; a last word that all parts share in the source is attached to each part without one."""
    parts, depth, now = [], 0, ""
    for c in text:
        depth += (c in "([{") - (c in ")]}" and depth > 0)
        if c == dot and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += c
    parts = [p.strip() for p in [*parts, now] if p.strip()]
    tail = parts[-1].split()[-1] if parts and len(parts[-1].split()) > 1 else ""
    return [p if len(p.split()) > 1 or not tail or i == len(parts) - 1 else f"{p} {tail}" for i, p in enumerate(parts)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_claims_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: split_claims(x or ""))
