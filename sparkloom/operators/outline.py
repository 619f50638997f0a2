"""Order-dependent parsers of hierarchical text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marker kinds from the outermost to the innermost level.
LEVELS = (re.compile(r"(\d+)\.\s"), re.compile(r"\((\d+)\)\s"), re.compile(r"([a-z])\)\s"), re.compile(r"(-)\s"))


def outline(text: str) -> list[tuple[int, int, int, str, str, str]]:
    """(line, section, level, marker, dotted path, body) of each line; a number that does not grow starts a new section.

    Lines without a marker continue the body of the node before them.
    """
    out: list[list] = []
    stack: list[tuple[int, str]] = []
    section, last_top = 0, 0
    dashes: dict[str, int] = {}
    for n, line in enumerate(text.split("\n")):
        s = line.strip()
        level = next((k for k, p in enumerate(LEVELS) if p.match(s)), None)
        if level is None:
            if out and s:
                out[-1][5] = f"{out[-1][5]} {s}".strip()
            elif s:
                out.append([n, section, -1, "", "", s])
            continue
        m = LEVELS[level].match(s)
        marker = m[1]
        while stack and stack[-1][0] >= level:
            stack.pop()
        above = ".".join(x for _, x in stack)
        if level == 0:
            section += int(marker) <= last_top
            last_top = int(marker)
        if marker == "-":
            dashes[above] = dashes.get(above, 0) + 1
            marker = f"-{dashes[above]}"
        stack.append((level, marker))
        out.append([n, section, level, marker, ".".join(x for _, x in stack), s[m.end() :].strip()])
    return [tuple(x) for x in out]


@F.udtf(returnType=T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("section", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("marker", T.StringType()), T.StructField("path", T.StringType()), T.StructField("body", T.StringType())]))
class OutlineTree:
    """UDTF form of :func:`outline`."""

    def eval(self, text: str):
        yield from outline(text or "")


#: What the planner expects of a partition of rows, in bytes; sorted rows take several times that.
PART_BYTES = 8 << 20


def parts_for(rows: DataFrame) -> int:
    """Shuffle partitions as set, and more where the planner's estimate of the rows' size needs them."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n if size >= 1 << 60 else max(n, -(-size // PART_BYTES))


def unique_paths(rows: DataFrame, doc: str, seq: str, path: str) -> DataFrame:
    """Duplicate paths of a document all get a ~k suffix in order; descendants follow the last such path before them.

    Rows are dealt by document once, into partitions whose number grows with the input; windows, join and groups then stay in them.
    """
    rows = rows.repartition(parts_for(rows), doc)
    w = Window.partitionBy(doc, path)
    r = rows.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(seq))})
    own = r.withColumn("fixed", F.when(F.col("_n") > 1, F.concat(path, F.lit("~"), F.col("_k").cast("string"))).otherwise(F.col(path)))
    parents = own.where("_n > 1").select(F.col(doc).alias("_d"), F.col(seq).alias("_s"), F.col(path).alias("_p"), F.col("fixed").alias("_f"))
    below = own.alias("x").join(parents, (F.col(f"x.{doc}") == F.col("_d")) & (F.col("_s") < F.col(f"x.{seq}")) & F.col(f"x.{path}").startswith(F.concat("_p", F.lit("."))), "left")
    last = below.groupBy(f"x.{doc}", f"x.{seq}", f"x.{path}", "fixed").agg(F.max_by(F.struct("_p", "_f"), "_s").alias("_a"))
    return last.select(doc, seq, path, F.when(F.col("_a").isNotNull(), F.concat(F.col("_a._f"), F.substring(F.col("fixed"), F.length("_a._p") + 1, F.length("fixed")))).otherwise(F.col("fixed")).alias("unique_path"))
