"""Line dedup by site-relative frequency.

A line is boilerplate of a host when the pages of the host that hold it are more than ``RATIO`` of
the host's pages.  Pages with one text count as one page, above and below the line, so that copies of
a page do not turn its content into boilerplate.  A line of a single page repeats nothing and is never
boilerplate, whatever its share of a small host.

A host's boilerplate has at most (mean distinct lines of a page) / RATIO lines, whatever the host's
size, so it travels as one array per host; Spark broadcasts the table of arrays if it is small and
joins by host otherwise.  Pages are never collected.  Lines are compared by 64-bit hash within their
host.

Defined cases: a line ends at each line feed; lines of white space only are kept and never counted; a
null text stays null and has no lines; null is a host of its own; repeated rows are one page and get
equal results; an empty table gives an empty result; other columns pass through untouched, whatever
their names (n_lines and n_dropped of the input are replaced by the operator's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.llm.common import stored

RATIO = 0.05


def _host(source: str) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def _blank(line: Column) -> Column:
    return F.length(F.trim(F.translate(line, "\t\r\f\v", "    "))) == 0


def boilerplate(docs: DataFrame, ratio: float = RATIO, text: str = "text", source: str = "source") -> DataFrame:
    """(host, lines): hashes of the boilerplate lines of each host that has any."""
    pages = docs.where(F.col(text).isNotNull()).select(_host(source).alias("host"), F.xxhash64(text).alias("page"), F.col(text).alias("text"))
    total = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    hashes = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: ~_blank(x)), lambda x: F.xxhash64(x)))
    lines = pages.select("host", "page", F.explode(hashes).alias("line")).distinct()
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    # Stored, so that the join with a host's total is not laid out for the grouping by host: Spark may split a large host.
    over = stored(docs.sparkSession, counted.join(total, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line"), "over")
    return over.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def without_boilerplate(docs: DataFrame, ratio: float = RATIO, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with the text's boilerplate lines dropped, and n_lines and n_dropped."""
    # Stored first: its size is known when the join is planned, so that a small table is broadcast and pages stay where they are.
    found = stored(docs.sparkSession, boilerplate(docs, ratio, text, source), "boilerplate")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _host(source).alias("host")).join(found, "host", "left")
    split = F.split(F.col("row").getField(text), "\n")
    kept = F.when(F.col("lines").isNull(), split).otherwise(F.filter(split, lambda x: _blank(x) | ~F.array_contains("lines", F.xxhash64(x))))
    out = rows.select("row", split.alias("split"), kept.alias("kept"))
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    columns = [F.array_join("kept", "\n").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, size("split").alias("n_lines"), (size("split") - size("kept")).alias("n_dropped"))


def oracle(ratio: float = RATIO) -> str:
    """The same in DuckDB SQL over ``documents``."""
    blank = "length(trim(translate({0}, chr(9) || chr(13) || chr(12) || chr(11), '    '))) = 0"
    return f"""
    WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
    total AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
    lines AS (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM pages),
    counted AS (SELECT source, line, count(*) AS n FROM lines WHERE NOT ({blank.format("line")}) GROUP BY source, line HAVING count(*) > 1),
    boilerplate AS (SELECT c.source, list(c.line) AS lines FROM counted c JOIN total t ON c.source IS NOT DISTINCT FROM t.source
        WHERE c.n > {ratio}::DOUBLE * t.pages GROUP BY c.source),
    cut AS (SELECT d.doc_id, string_split(d.text, chr(10)) AS l, coalesce(b.lines, []) AS lines FROM documents d LEFT JOIN boilerplate b ON d.source IS NOT DISTINCT FROM b.source),
    kept AS (SELECT doc_id, l, list_filter(l, lambda x: NOT list_contains(lines, x)) AS k FROM cut)
    SELECT doc_id, array_to_string(k, chr(10)) AS text, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(len(k), 0))::BIGINT AS n_dropped FROM kept"""
