"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.byte_bpe import round_trip
from sparkloom.llm.decontaminate import contaminated
from sparkloom.llm.exact_dedup import exact_dedup
from sparkloom.llm.html_render import html_render
from sparkloom.llm.merkle import document_proofs
from sparkloom.llm.packing import packed
from sparkloom.llm.parity_join import jaccard_components
from sparkloom.llm.quality_crf import quality
from sparkloom.llm.spelling import spelling_variants
from sparkloom.llm.suffix_dedup import suffix_dedup
from sparkloom.llm.token_counts import token_counts
from sparkloom.llm.token_records import encode_to_records
from sparkloom.llm.url_filter import url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents"))


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark, table(spark, sf_dir, "pages"), URL_RULES)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render(table(spark, sf_dir, "pages"))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_records(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark, table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_proofs(spark, table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark, table(spark, sf_dir, "documents"))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Distinct 5-word shingles (id, g) of a table's texts, A-Z lowered; a text with fewer words is one shingle.
SHINGLES = r"""{out}_words AS (
            SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
        {out}_at AS (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM {out}_words WHERE len(w) > 0),
        {out} AS (SELECT DISTINCT id, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM {out}_at)"""

#: CRC-32 in SQL: its table of 256 entries, made by its rule, and the sum of a list of bytes.
CRC_TABLE = """crc_ AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c}) END" for c in fields) + ")"


ORACLE = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
    """,
    "op6_parity_join": f"""
        WITH RECURSIVE {SHINGLES.format(table="documents", id="doc_id", out="s")},
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
        links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a AS id, a AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
        least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN least ON least.id = d.doc_id
    """,
    "op7_decontaminate": f"""
        WITH {SHINGLES.format(table="documents", id="doc_id", out="s")}, {SHINGLES.format(table="benchmark", id="item_id", out="b")},
        n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
        SELECT s.id AS doc_id, b.id AS item_id, n.n_item, count(*) AS n_common, count(*) / n.n_item AS containment
        FROM s JOIN b ON s.g = b.g JOIN n ON n.id = b.id GROUP BY s.id, b.id, n.n_item HAVING 100 * count(*) >= 75 * n.n_item
    """,
    "op11_merkle_manifest": f"""
        WITH RECURSIVE {CRC_TABLE},
        leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS leaf,
            CASE WHEN {CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS other FROM documents, crc_),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id, count(*) OVER (PARTITION BY g) AS cnt FROM leaves),
        low AS (SELECT g, 0 AS level, pos AS idx, leaf AS h, cnt FROM placed
            UNION ALL SELECT g, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(cnt) + 1) // 2 FROM low WHERE cnt > 1 GROUP BY g, level, idx // 2),
        tops AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS cnt FROM low WHERE cnt = 1),
        high AS (SELECT 0 AS level, pos AS idx, subroot AS h, cnt FROM tops
            UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(cnt) + 1) // 2 FROM high WHERE cnt > 1 GROUP BY level, idx // 2),
        asked AS (SELECT DISTINCT p.id, p.g, l.level, p.pos >> l.level AS own, FALSE AS over FROM placed p JOIN (SELECT DISTINCT g, level FROM low WHERE cnt > 1) l USING (g)
            UNION ALL SELECT p.id, '', l.level, t.pos >> l.level, TRUE FROM placed p JOIN tops t USING (g), (SELECT DISTINCT level FROM high WHERE cnt > 1) l),
        every AS (SELECT g, level, idx, h, FALSE AS over FROM low UNION ALL SELECT '', level, idx, h, TRUE FROM high),
        way AS (SELECT a.id, a.own % 2 AS place, e.h, row_number() OVER (PARTITION BY a.id ORDER BY a.over, a.level) AS k
            FROM asked a LEFT JOIN every e ON e.g = a.g AND e.over = a.over AND e.level = a.level AND e.idx = xor(a.own, 1)),
        folded AS (SELECT id, 0 AS k, coalesce(other, leaf) AS d FROM placed
            UNION ALL SELECT f.id, f.k + 1, sha256(CASE WHEN w.h IS NULL THEN f.d WHEN w.place = 0 THEN f.d || w.h ELSE w.h || f.d END) FROM folded f JOIN way w ON w.id = f.id AND w.k = f.k + 1),
        last AS (SELECT id, arg_max(d, k) AS folded_root FROM folded GROUP BY id),
        proof AS (SELECT p.id, sha256(coalesce(string_agg(w.h, '' ORDER BY w.k), '')) AS proof_sha256 FROM placed p LEFT JOIN way w USING (id) GROUP BY p.id),
        root AS (SELECT h AS root FROM high WHERE cnt = 1)
        SELECT p.doc_id, p.leaf, t.subroot, root, proof_sha256, folded_root, folded_root = root AS verified
        FROM placed p JOIN tops t USING (g) JOIN proof USING (id) JOIN last USING (id), root
    """,
    "op12_spelling_variants": f"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{{7,}}')) AS w FROM documents),
        hashed AS (SELECT w, {CRC.format(bytes="list_transform(string_split(doc_id || ':', ''), lambda x: ascii(x)::BIGINT) || flatten(list_transform(string_split(w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))")} AS h FROM runs, crc_),
        spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w FROM hashed),
        v AS (SELECT w, count(*) AS n FROM spelt WHERE length(w) >= 7 GROUP BY w HAVING count(*) >= 2),
        at_ AS (SELECT w, n, unnest(generate_series(1, length(w))) AS k FROM v),
        open_ AS (SELECT w, n, k, substr(w, 1, k - 1) AS a, substr(w, k + 1) AS z FROM at_),
        less AS (SELECT DISTINCT w, n, a || z AS d FROM open_),
        near AS (SELECT x.w, y.w AS o, y.n AS on_ FROM open_ x JOIN open_ y ON x.k = y.k AND x.a = y.a AND x.z = y.z AND x.w <> y.w
            UNION ALL SELECT l.w, v.w, v.n FROM less l JOIN v ON v.w = l.d UNION ALL SELECT v.w, l.w, l.n FROM less l JOIN v ON v.w = l.d),
        best AS (SELECT w, o, on_, row_number() OVER (PARTITION BY w ORDER BY on_ DESC, o) AS r, count(*) OVER (PARTITION BY w) AS n_near FROM near),
        formed AS (SELECT v.w, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.on_ >= 10 * v.n THEN b.o END AS form, CASE WHEN b.on_ >= 10 * v.n THEN b.on_ END AS form_n FROM v LEFT JOIN best b ON b.w = v.w AND b.r = 1),
        steps AS (SELECT w, w AS root, form AS next FROM formed UNION ALL SELECT s.w, f.w, f.form FROM steps s JOIN formed f ON f.w = s.next)
        SELECT f.w AS word, f.form, s.root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s ON s.w = f.w AND s.next IS NULL
    """,
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if v}
