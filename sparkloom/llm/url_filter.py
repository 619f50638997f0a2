"""URL filter: rules first, gradient-boosted trees on lexical features for what no rule fits.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's; the longest rule wins.
URLs that a rule decides are the labelled URLs. The trees are trained on a bounded sample of them (``sample`` rows with the
smallest hash of url and page_id) with logistic loss; features: lengths of url, host, path and query, depth, host labels, digit ratio,
other marks, entropy of the url's bytes, number of parameters, longest run of digits, fragment, scheme, and the statistics of the
host's suffix (its last label): how many urls have it, and its smoothed share of blocked ones among the labelled. Suffix statistics
count all urls. A url that no rule fits is blocked where its predicted chance to be blocked is 0.5 or more.

Null urls and those without ``://`` have empty host and path, no rule, and go to the trees like others. Without labelled urls of
both verdicts, the verdict is that of the labelled ones, or allow. Repeated page_ids each give a row; an empty table gives none. Rules of equal
length that fit a url are equal, so there are no ties. Very long urls are judged whole, 2,000 urls at a time. Extra columns, also such
whose names differ only in case, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import TextView, heavy_at, join_by_key, lowered_az, plain, smallest_hashes

Rule = tuple[str, str]  # "host/path", "allow" or "block"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, lowered_az(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule], verdict: bool) -> Column:
    """The longest rule that fits (or its verdict), else null."""
    out = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one comes later and so is tried earlier
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(says if verdict else rule)).otherwise(out)
    return out


# ---------------------------------------------------------------- features

N_FEATURES = 16


def features(url: pa.Array, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(rows, N_FEATURES): lexical features of the urls; n and share: of their suffixes."""
    v = TextView(url)
    m, data, off = len(v), v.data, v.offsets
    size = np.maximum(1, v.lengths)
    row = np.repeat(np.arange(m), v.lengths)

    def count(mask):
        acc = np.r_[0, np.cumsum(mask)]
        return acc[off[1:]] - acc[off[:-1]]

    of = lambda s: count(np.isin(data, [ord(c) for c in s]))
    digit = (data >= 48) & (data <= 57)
    freq = np.bincount(row * 256 + data, minlength=m * 256).reshape(m, 256) / size[:, None]
    entropy = -(freq * np.log2(np.where(freq > 0, freq, 1))).sum(axis=1)
    run = np.zeros(m)
    edge = np.flatnonzero(np.diff(np.r_[0, digit.astype(np.int8), 0]))
    if len(edge):
        np.maximum.at(run, row[edge[::2]], edge[1::2] - edge[::2])
    raw = [v.raw(i) for i in range(m)]
    host = [x.partition(b"://")[2].split(b"/")[0].split(b"?")[0].split(b"#")[0] for x in raw]
    query = [x.partition(b"?")[2].partition(b"#")[0] for x in raw]
    return np.stack([
        size, [len(h) for h in host], [len(q) for q in query], of("/"), [h.count(b".") for h in host], count(digit) / size, run,
        of("-_"), of("%~@!+,;"), entropy, [q.count(b"&") + (len(q) > 0) for q in query], of("#") > 0, [x.startswith(b"https:") for x in raw],
        count((data >= 65) & (data <= 90)) / size, np.log1p(n), share,
    ], axis=1).astype(np.float64)


class Trees:
    """Boosted complete binary trees: histogram splits on quantile bins, logistic loss."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.15, bins: int = 32, least: int = 5, penalty: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.least, self.penalty = depth, rounds, rate, bins, least, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(n, self.base)
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.feature, self.cut, self.value = np.zeros((self.rounds, inner), np.int64), np.full((self.rounds, inner), np.inf), np.zeros((self.rounds, leaves))
        for t in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                nodes = 1 << level
                key = (node[:, None] * f + np.arange(f)) * (self.bins + 1) + binned
                shape = (nodes, f, self.bins + 1)
                hist = [np.bincount(key.ravel(), np.repeat(w, f), minlength=nodes * f * (self.bins + 1)).reshape(shape).cumsum(axis=2) for w in (g, h, np.ones(n))]
                (gl, hl, nl), (gt, ht, nt) = hist, (a[:, :, -1:] for a in hist)
                gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(nl < self.least) | (nt - nl < self.least)] = 0
                best = gain.reshape(nodes, -1).argmax(axis=1)
                for k in range(nodes):
                    j, b = divmod(int(best[k]), self.bins + 1)
                    if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                        self.feature[t, nodes - 1 + k], self.cut[t, nodes - 1 + k] = j, cuts[j][b]
                at = nodes - 1 + node
                node = node * 2 + (x[np.arange(n), self.feature[t, at]] > self.cut[t, at])
            gs, hs = np.bincount(node, g, minlength=leaves), np.bincount(node, h, minlength=leaves)
            self.value[t] = self.rate * gs / (hs + self.penalty)
            margin += self.value[t, node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            margin += self.value[t, node]
        return 1 / (1 + np.exp(-margin))


def url_filter(spark: SparkSession, pages: DataFrame, rules: Sequence[Rule], sample: int = 20_000) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every row of ``pages`` (page_id, url)."""
    url = F.col("url")
    named = plain(pages, "page_id", "url").withColumn("host", F.coalesce(host_of(url), F.lit(""))).withColumn("path", F.coalesce(path_of(url), F.lit("")))
    named = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, False)).withColumn("said", rule_of(F.col("host"), F.col("path"), rules, True))
    named = named.withColumn("suffix", F.substring_index("host", ".", -1))
    blocked = F.col("said") == "block"
    stats = named.groupBy("suffix").agg(F.count("*").alias("n"), F.count("said").alias("known"), F.coalesce(F.sum(blocked.cast("long")), F.lit(0)).alias("bad"))
    totals = stats.agg(F.sum("n"), F.sum("known"), F.sum("bad")).first()
    total, known, bad = (int(x or 0) for x in totals)
    prior = bad / known if known else 0.0
    stats = stats.select("suffix", "n", ((F.col("bad") + 20 * F.lit(prior)) / (F.col("known") + 20)).alias("share"))
    joined = join_by_key(named, stats, "suffix", "n", heavy_at(total))
    model = None
    if 0 < bad < known:
        key = F.xxhash64("url", "page_id")
        near = smallest_hashes(joined.where(F.col("said").isNotNull()), key, known, sample)
        picked = near.orderBy(key, "page_id").limit(sample).select("url", "n", "share", "said").toPandas()  # a stated bound
        model = Trees().fit(features(pa.array(picked["url"]), picked["n"].to_numpy(), picked["share"].to_numpy()), (picked["said"] == "block").to_numpy(float))
    fallback = float(prior >= 0.5 and known > 0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                c = b.slice(at, 2000)
                p = model.predict(features(c.column("url"), c.column("n").to_numpy(), c.column("share").to_numpy())) if model else np.full(c.num_rows, fallback)
                says = pa.array([s or ("block" if x >= 0.5 else "allow") for s, x in zip(c.column("said").to_pylist(), p.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([c.column("page_id").cast(pa.int64()), c.column("host"), c.column("path"), c.column("rule"), says, pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "p_block"])

    return joined.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, p_block double")
