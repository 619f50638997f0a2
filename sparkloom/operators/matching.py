"""Dictionary joins, claim matching, near duplicates, leak joins, censuses, dictionary building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import match_norm
from sparkloom.operators import automaton
from sparkloom.operators.numbering import numbered, written
from sparkloom.session import shared_folder

#: How many first characters of a term are looked up, and in how many places of a text at a time.
GRAM, PLACES = 6, 256


def containing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct pairs (text_norm, term_norm) where the one contains the other, by an equi-join on the first characters of the term.

    A term of fewer than ``GRAM`` characters is looked up as a whole. The lookup moves digests of texts, not the texts.
    """
    n = terms.select("term_norm").distinct().withColumn("_g", F.substring("term_norm", 1, GRAM))
    t = texts.select("text_norm").distinct().withColumn("_h", F.sha2("text_norm", 256))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text_norm"), F.lit(1)), F.lit(PLACES)), lambda k: F.col("text_norm").substr(k, F.lit(PLACES + GRAM - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_p"), F.lit(1))), lambda k: F.col("_p").substr(k, F.col("_w")))
    widths = F.broadcast(n.select(F.length("_g").alias("_w")).distinct())
    places = t.select("_h", F.explode(parts).alias("_p")).crossJoin(widths).select("_h", F.explode(F.array_distinct(grams)).alias("_g"))
    found = places.join(n, "_g").select("_h", "term_norm").distinct()
    return t.join(found, "_h").where("instr(text_norm, term_norm) > 0").select("text_norm", "term_norm")


def dictionary_hits(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Theta join: (row, term) where the matching form of the term lies in that of the text, with its first 1-based position there."""
    t = terms.withColumn("term_norm", match_norm(F.col("term")))
    d = docs.withColumn("text_norm", match_norm(F.col(text)))
    return contained_at(d, t).drop("text_norm", "term_norm")


def contained_at(texts: DataFrame, terms: DataFrame, block: int = automaton.BLOCK, most: int = automaton.BLOCKS) -> DataFrame:
    """Pairs of rows where ``text_norm`` contains ``term_norm``, with its first place ``at``.

    The terms go to the tasks as automata, in blocks of ``block`` characters; a dictionary of more than ``most`` blocks meets the texts on its first characters, with the same rows.
    """
    blocks = automaton.term_blocks(terms, "term_norm", block, most)
    if blocks is not None:
        return automaton.hits(texts, terms, blocks)
    met = texts.join(containing(texts, terms), "text_norm").join(terms, "term_norm").select(*texts.columns, *terms.columns)
    return met.withColumn("at", F.expr("instr(text_norm, term_norm)"))


def contained(texts: DataFrame, terms: DataFrame, block: int = automaton.BLOCK, most: int = automaton.BLOCKS) -> DataFrame:
    """Pairs of rows where ``text_norm`` contains ``term_norm``."""
    return contained_at(texts, terms, block, most).drop("at")


def admissible_span(text: str, term: str) -> tuple[int, int] | None | str:
    """Raw span of the first admissible place of a term; ``"no span"`` where folding per character and as a whole differ."""
    got = automaton.spans(text, *automaton.spans_of([term])).get(0)
    return "no span" if got == (None, None) else got


def only_of(hits: DataFrame, law: str, cites: str) -> DataFrame:
    """Hits with a citation of this law, with only those citations."""
    return hits.withColumn(cites, F.filter(cites, lambda c: c.startswith(law + ":"))).where(F.size(cites) > 0)


def routed(rows: DataFrame, scope: DataFrame, category: str) -> DataFrame:
    """Each row with the laws of its category; a law without scope takes all, a row without category goes to all."""
    fits = F.col("scope").isNull() | F.col(category).isNull() | F.array_contains("scope", F.col(category))
    return rows.join(scope, fits)


def shingle_pairs(docs: DataFrame, key: str, grams: Column, num: int, den: int, most: int | None = None) -> DataFrame:
    """Pairs (a, b, similarity) with Jaccard of gram sets at least num / den, through an inverted index.

    Only the first size * (1 - num / den) + 1 grams in order of rarity index a row: two sets that are similar enough share one of
    those. ``most`` drops grams of more rows; it is an explicit option and off by default.
    """
    sets = docs.select(key, F.array_distinct(grams).alias("g")).where(F.size("g") > 0)
    flat = sets.select(key, F.size("g").alias("n"), F.explode("g").alias("gram"))
    df = flat.groupBy("gram").agg(F.count("*").alias("df"))
    if most:
        df = df.where(F.col("df") <= most)
    order = Window.partitionBy(key).orderBy("df", "gram")
    prefix = flat.join(df.where("df > 1"), "gram").withColumn("r", F.row_number().over(order)).withColumn("p", F.col("n") - F.ceil(F.col("n") * num / den) + 1).where("r <= p")
    index = prefix.select(key, "n", "gram")
    a, b = index.select(F.col(key).alias("a"), F.col("n").alias("na"), "gram"), index.select(F.col(key).alias("b"), F.col("n").alias("nb"), "gram")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    pairs = a.join(b, "gram").where(near).select("a", "b").distinct()
    full = pairs.join(sets.select(F.col(key).alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col(key).alias("b"), F.col("g").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    scored = full.select("a", "b", common.alias("c"), (F.size("ga") + F.size("gb") - common).alias("u"))
    return scored.where(F.col("c") * den >= F.col("u") * num).select("a", "b", F.round(F.col("c") / F.col("u"), 6).alias("similarity"))


def min_label_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, comp by iterated smallest labels with pointer jumping until nothing changes; the lineage is cut by reliable checkpoints."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct().checkpoint()
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp"))
    seen, total = None, ()
    while total != seen:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = labels.join(near, "u", "left").select("u", F.least("comp", "m").alias("comp"))
        jump = step.select(F.col("u").alias("comp"), F.col("comp").alias("j"))
        labels = step.join(jump, "comp", "left").select("u", F.least("comp", F.coalesce("j", "comp")).alias("comp")).checkpoint()
        seen, total = total, labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]  # labels only get smaller
    return labels.select(F.col("u").alias("node"), "comp")


def drop_leaks(train: DataFrame, sealed: DataFrame, text: str, long_key: int = 40) -> DataFrame:
    """Train rows whose key equals a sealed one, or that contain a long sealed key, go."""
    keys = sealed.select(match_norm(F.col(text)).alias("_k")).where("_k <> ''").distinct()
    t = train.withColumn("_n", match_norm(F.col(text)))
    equal = t.join(keys, F.col("_n") == F.col("_k"), "left_anti")
    long = keys.where(F.length("_k") >= long_key).withColumnRenamed("_k", "term_norm")
    leaks = contained(equal.select(F.col("_n").alias("text_norm")).distinct(), long).select(F.col("text_norm").alias("_n")).distinct()
    return equal.join(leaks, "_n", "left_anti").select(*train.columns)


def duplicate_census(df: DataFrame, page: str) -> DataFrame:
    """rows, distinct rows, kinds of duplicates, excess, and duplicates within a page against those across pages."""
    h = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != page]), {"ignoreNullFields": "false"}), 256)
    g = df.select(h.alias("h"), page).groupBy("h").agg(F.count("*").alias("n"), F.countDistinct(page).alias("pages"))
    return g.agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.count_if(F.col("n") > 1).alias("dup_kinds"), F.sum(F.col("n") - 1).alias("excess"),
        F.count_if((F.col("n") > 1) & (F.col("pages") == 1)).alias("within_page"), F.count_if(F.col("pages") > 1).alias("across_pages"),
    )


def boilerplate(phrases: DataFrame, doc: str, phrase: str, least: int = 4) -> DataFrame:
    """Phrases in at least ``least`` different documents."""
    return phrases.select(doc, phrase).distinct().groupBy(phrase).agg(F.count("*").alias("docs")).where(F.col("docs") >= least)


def lexicon(df: DataFrame, words: Column, least: int) -> DataFrame:
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def build_dictionary(entries: DataFrame, approved: DataFrame, claims_not: DataFrame) -> DataFrame:
    """Terms with sets of types and sources, raw forms (5 at most), and the confidence; only ``single`` may decide.

    entries: term, type, source; approved and claims_not: term of those that lie in approved or in non-claim sentences.
    """
    e = entries.withColumn("norm", match_norm(F.col("term")))
    g = e.groupBy("norm").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("source")).alias("sources"), F.slice(F.array_sort(F.collect_set("term")), 1, 5).alias("raws"))
    j = g.join(approved.select(match_norm(F.col("term")).alias("norm")).distinct().withColumn("_a", F.lit(True)), "norm", "left").join(claims_not.select(match_norm(F.col("term")).alias("norm")).distinct().withColumn("_c", F.lit(True)), "norm", "left")
    confidence = F.when(F.col("_a"), "approved").when(F.size("types") > 1, "ambiguous").when(F.col("_c"), "non_claim").otherwise("single")
    return j.select("norm", "types", "sources", "raws", confidence.alias("confidence"), (confidence == "single").alias("decides"))


def nearly_equal(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs (_c, _o) that hold all with an edit ratio of at least ``least`` (above 0), and others.

    Of a _o cut into one piece more than the edits that any such partner may need, one piece stands unchanged in the partner, moved by
    no more than the edits on its left or on its right allow; rows meet on length, number and text of a piece.
    """
    low, high = lambda n: F.ceil(n * least - 1e-9).cast("int"), lambda n: F.floor(n / least + 1e-9).cast("int")
    piece = lambda df: df.withColumn("_k", F.floor(F.col("_n") * ((1 - least) / least) + 1e-9).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k")))).withColumns(
        {"_from": F.floor(F.col("_i") * F.col("_n") / (F.col("_k") + 1)).cast("int"), "_to": F.floor((F.col("_i") + 1) * F.col("_n") / (F.col("_k") + 1)).cast("int")}
    )
    o = piece(b.select("_o", F.length("_o").alias("_n")).distinct().where("_n > 0"))
    o = o.select("_o", "_n", "_i", F.col("_o").substr(F.col("_from") + 1, F.col("_to") - F.col("_from")).alias("_p"))
    size = F.length("_c")
    c = a.select("_c").distinct().where(size > 0).withColumn("_n", F.explode(F.sequence(low(size), high(size))))
    c = piece(c.join(F.broadcast(o.select("_n").distinct()), "_n"))
    more = size - F.col("_n")
    first = F.greatest(-F.col("_i"), more - (F.col("_k") - F.col("_i")), -F.col("_from"))
    last = F.least(F.col("_i"), more + (F.col("_k") - F.col("_i")), size - F.col("_to"))
    c = c.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("_move", F.explode(F.sequence("_first", "_last")))
    c = c.select("_c", "_n", "_i", F.col("_c").substr(F.col("_from") + F.col("_move") + 1, F.col("_to") - F.col("_from")).alias("_p"))
    return c.join(o, ["_n", "_i", "_p"]).select("_c", "_o").distinct()


def deletions(c: Column) -> Column:
    """The string and all strings with one character less, each once."""
    less = F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.concat(F.substring(c, F.lit(1), k - 1), F.substring(c, k + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, less).otherwise(F.array().cast("array<string>"))))


def one_edit(a: DataFrame, b: DataFrame, left: str, right: str, in_bytes: bool = False) -> DataFrame:
    """Pairs (left, right) of different strings with one insertion, deletion or replacement between them.

    Such strings share a deletion, or one is a deletion of the other; they meet by an equi-join on these, which spread as the strings do, and are verified.
    ``in_bytes``: the edit is one byte of UTF-8, as DuckDB's levenshtein counts; it never changes more than one character, so the same strings meet.
    """
    unit = (lambda c: F.decode(F.encode(F.col(c), "UTF-8"), "ISO-8859-1")) if in_bytes else F.col  # a character a byte
    x = a.select(left).distinct().withColumn("_k", F.explode(deletions(F.col(left))))
    y = b.select(right).distinct().withColumn("_k", F.explode(deletions(F.col(right))))
    met = x.join(y, "_k").where((F.col(left) != F.col(right)) & (F.abs(F.length(left) - F.length(right)) <= 1))
    return met.where(F.call_function("levenshtein", unit(left), unit(right), F.lit(1)) >= 0).select(left, right).distinct()


def best_claim(claims: DataFrame, official: DataFrame, least: float = 0.8) -> DataFrame:
    """exact > core equal > contains > contained > nearest by edit distance at least ``least`` (above 0), else none.

    Distinct matching forms meet by equi-joins only; the best of the pairs found is the best of all pairs.
    """
    o = official.select(F.col("name"), match_norm(F.col("name")).alias("_o"))
    c = claims.withColumn("_c", match_norm(F.col("claim")))
    forms, names = c.select("_c").where("_c IS NOT NULL").distinct(), o.select("_o").where("_o IS NOT NULL").distinct()
    equal = forms.join(names, F.col("_c") == F.col("_o"))
    rest = forms.join(names, F.col("_c") == F.col("_o"), "left_anti")
    as_text, as_term = lambda df, x: df.select(F.col(x).alias("text_norm")), lambda df, x: df.select(F.col(x).alias("term_norm"))
    contains = containing(as_text(rest, "_c"), as_term(names, "_o")).select(F.col("text_norm").alias("_c"), F.col("term_norm").alias("_o"))
    contained = containing(as_text(names, "_o"), as_term(rest, "_c")).select(F.col("term_norm").alias("_c"), F.col("text_norm").alias("_o"))
    pairs = equal.unionByName(contains).unionByName(contained).unionByName(nearly_equal(rest, names, least)).distinct()
    ratio = 1 - F.levenshtein("_c", "_o") / F.greatest(F.length("_c"), F.length("_o"), F.lit(1))
    rank = F.when(F.col("claim") == F.col("name"), 5).when(F.col("_c") == F.col("_o"), 4).when(F.expr("instr(_c, _o) > 0"), 3).when(F.expr("instr(_o, _c) > 0"), 2).when(ratio >= least, 1)
    hits = c.join(pairs, "_c").join(o, "_o").where(rank.isNotNull())
    best = hits.groupBy("claim_id").agg(F.max(F.struct(rank.alias("rank"), F.round(ratio, 6).alias("ratio"), "name")).alias("b"))
    kind = F.when(F.col("b.rank") == 5, "exact").when(F.col("b.rank") == 4, "core").when(F.col("b.rank") == 3, "contains").when(F.col("b.rank") == 2, "contained").when(F.col("b.rank") == 1, "near").otherwise("none")
    return claims.select("claim_id").join(best, "claim_id", "left").select("claim_id", kind.alias("kind"), "b.name", "b.ratio")


def first_of_similar(rows: DataFrame, group: str, order: str, norm: str, reason: str) -> DataFrame:
    """(group, order, reason) with ``duplicate`` for rows without a reason whose norm has an edit ratio of at least 0.8 to one accepted before.

    An equal norm is decided by rank, as what stands against the first stands against all; only first ones are held against each other.
    """
    n = F.row_number().over(Window.partitionBy(group, norm).orderBy(order))
    free = rows.where(F.col(reason).isNull()).select(group, order, norm, n.alias("_n"))
    longer = lambda a, b: F.greatest(F.length(a), F.length(b))
    near = lambda a, b: (F.least(F.length(a), F.length(b)) * 5 >= longer(a, b) * 4) & (F.call_function("levenshtein", a, b, F.floor(longer(a, b) / 5).cast("int")) >= 0)
    state = lambda x, new: F.array(F.struct(x[norm].alias("norm"), new.alias("new")))
    add = lambda acc, x: F.concat(acc, state(x, ~F.exists(acc, lambda y: y["new"] & F.coalesce(near(y["norm"], x[norm]), F.lit(False)))))
    sets = free.where("_n = 1").groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, norm))).alias("_r"))
    seen = sets.withColumn("_s", F.aggregate("_r", F.expr("CAST(array() AS array<struct<norm:string,new:boolean>>)"), add))
    first = seen.select(group, F.explode(F.arrays_zip("_r", "_s")).alias("_z")).select(group, F.col(f"_z._r.{order}").alias(order), F.when(~F.col("_z._s.new"), "duplicate").alias(reason))
    rest = free.where("_n > 1").select(group, order, F.lit("duplicate").alias(reason))
    return rows.where(F.col(reason).isNotNull()).select(group, order, reason).unionByName(first).unionByName(rest)


def alike(a: Column, b: Column) -> Column:
    """Whether the edit ratio of two strings is at least 0.8."""
    longer = F.greatest(F.length(a), F.length(b))
    most = F.floor(longer / 5).cast("int")
    return (F.least(F.length(a), F.length(b)) * 5 >= longer * 4) & (F.call_function("levenshtein", a, b, most) >= 0)


def retry_rounds(spark: SparkSession, candidates: DataFrame, group: str, order: str, norm: str, reason: str, per_round: int = 4, rounds: int = 3, want: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rounds of ``per_round`` candidates for each group until it has ``want`` that are kept. Gives (groups: kept, rounds, state), (judged: order, reason, round).

    What a round carries is a written table: the texts that are kept, and the groups that are still open. A round reads only its own candidates of open groups and
    holds them against what was carried, fewer than ``want`` texts a group, and then against each other, ``per_round`` at most. The driver reads one flag a round.
    """
    dealt = written(numbered(candidates.select(group, order, norm, reason), [F.col(order)], "_n", by=[group]), "candidates")
    kept = dealt.limit(0).select(group, norm)
    groups = written(candidates.select(group).distinct().select(group, F.lit(0).alias("kept"), F.lit(0).alias("rounds"), F.lit(True).alias("open")), "groups")
    judged = []
    for k in range(1, rounds + 1):
        asked = dealt.where(F.col("_n").between((k - 1) * per_round + 1, k * per_round)).join(groups.where("open").select(group), group, "left_semi")
        before = kept.groupBy(group).agg(F.collect_list(norm).alias("_kept"))  # fewer than ``want`` in an open group
        seen = F.exists(F.coalesce("_kept", F.array().cast("array<string>")), lambda x: alike(x, F.col(norm)))
        free = asked.join(before, group, "left").withColumn(reason, F.when(F.col(reason).isNotNull(), F.col(reason)).when(seen, "duplicate")).drop("_kept")
        told = first_of_similar(free, group, order, norm, reason).join(asked.select(group, order, norm), [group, order])
        told = written(told.withColumn("round", F.lit(k)), f"round-{k}")
        judged.append(told.select(group, order, reason, "round"))
        new = told.where(F.col(reason).isNull())
        kept = written(kept.unionByName(new.select(group, norm)), f"kept-{k}")
        count = new.groupBy(group).agg(F.count("*").cast("int").alias("_new"))
        total = F.col("kept") + F.coalesce("_new", F.lit(0))
        groups = groups.join(count, group, "left").select(group, total.alias("kept"), (F.col("rounds") + F.col("open").cast("int")).alias("rounds"), (F.col("open") & (total < want)).alias("open"))
        groups = written(groups, f"groups-{k}")
        if groups.where("open").isEmpty():
            break
    every = judged[0]
    for x in judged[1:]:
        every = every.unionByName(x)
    return groups.select(group, F.least(F.col("kept"), F.lit(want)).alias("kept"), "rounds", F.when(F.col("open"), "search_failed").otherwise("ok").alias("state")), every


def gram_distance(a: Column, b: Column) -> Column:
    """1 less the Jaccard similarity of two arrays, in hundredths; 100 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 100).otherwise(F.floor(100 - 100 * both / either)).cast("int")


def tier_choice(rows: DataFrame, group: str, key: str, closeness: str, angle: str, grams: str) -> DataFrame:
    """key, tier (safe, even, bold) of three rows of each group that has three or more.

    Rows stand by closeness (then key). With a = n DIV 3, the first a are low, the last a high, the rest between. Safe is the lowest. Bold is the row of the high ones
    whose angle is new and whose grams are farthest from safe's, then the closest; even is the row between that is farthest from both in the same way, then
    nearest to the middle of their closeness (distances to thousandths). Ties: the smallest key. Groups are numbered in ranges and candidates reduced by maxima, so no group is gathered.
    """
    placed = written(numbered(rows.select(group, key, closeness, angle, F.array_distinct(grams).alias("_g")), [F.col(closeness), F.col(key)], "_n", by=[group], total="_all"), "tiers")
    a = F.floor(F.col("_all") / 3)
    enough = placed.where("_all >= 3")
    pick = lambda df, score: df.groupBy(group).agg(F.max_by(F.struct(key, closeness, angle, "_g"), F.struct(*score, (-F.col(key)).alias("k"))).alias("_p"))
    safe = written(enough.where("_n = 1").select(group, F.struct(key, closeness, angle, "_g").alias("_s")), "safe")
    high = enough.where(F.col("_n") > F.col("_all") - a).join(safe, group)
    new, far = ~F.col(angle).eqNullSafe(F.col(f"_s.{angle}")), gram_distance(F.col("_g"), F.col("_s._g"))
    bold = written(pick(high, [new.alias("n"), far.alias("d"), F.col(closeness).alias("c")]).select(group, F.col("_p").alias("_b")), "bold")
    mid = enough.where((F.col("_n") > a) & (F.col("_n") <= F.col("_all") - a)).join(safe, group).join(bold, group)
    new = new & ~F.col(angle).eqNullSafe(F.col(f"_b.{angle}"))
    far = F.least(far, gram_distance(F.col("_g"), F.col("_b._g")))
    off = F.round(F.abs(F.col(closeness) - (F.col(f"_s.{closeness}") + F.col(f"_b.{closeness}")) / 2), 3)
    even = pick(mid, [new.alias("n"), far.alias("d"), (-off).alias("c")])
    named = lambda df, c, tier: df.select(group, F.col(f"{c}.{key}").alias(key), F.lit(tier).alias("tier"))
    return named(safe, "_s", "safe").unionByName(named(even, "_p", "even")).unionByName(named(bold, "_b", "bold"))
