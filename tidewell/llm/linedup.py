"""Line dedup by overlapping windows of consecutive lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare
from .repeats import later_occurrences


def repeated_line_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 3) -> DataFrame:
    """Merged runs of lines that later occurrences of repeated windows cover: id, h (of the text), spans.

    Null texts and texts of fewer lines give none; rows that share id and text give one; a null id
    sorts first; an empty table gives no rows. Other columns are not looked at.
    """
    prepare(docs.sparkSession)
    hashed = ", ".join(f"l[i + {k}]" for k in range(window))
    mirrored = ", ".join(f"l[i + {k}]" for k in reversed(range(window)))
    blank = " || ".join(f"l[i + {k}]" for k in range(window))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.split(text_col, "\n", -1).alias("l")).where(F.size("l") >= window)
    units = (
        lines.select("id", "h", F.expr(
            f"filter(transform(if(size(l) < {window}, array(), sequence(0, size(l) - {window})), i -> if({blank} rlike '^[ \\\\t\\\\x0B\\\\f\\\\r]*$', null, "
            f"struct(i as i, xxhash64({hashed}) as a, xxhash64('#', {mirrored}) as b))), x -> x is not null)"
        ).alias("w")).select("id", "h", F.explode_outer("w").alias("w")).where("w is not null").select("id", "h", "w.i", "w.a", "w.b")
    )  # fmt: skip  # an outer explode, as for an inner one a filter with the whole expression is inferred and put before the split
    later = later_occurrences(units, ["a", "b"], ["id", "h", "i"]).select("id", "h", "i").distinct()
    doc = Window.partitionBy("id", "h")
    starts = later.withColumn("new", (F.col("i") > F.coalesce(F.lag("i").over(doc.orderBy("i")), F.lit(-9)) + window).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(doc.orderBy("i"))).groupBy("id", "h", "run").agg(F.min("i").alias("s"), (F.max("i") + window).alias("e"))
    return runs.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 3) -> DataFrame:
    """``docs`` without the lines that later occurrences of repeated ``window``-line windows cover.

    A window is ``window`` consecutive lines, split at \\n, hashed to 128 bits. The occurrence with
    the least (id, line) stays; the lines of every other, in the same text too, are removed, after
    the covered positions are merged. Windows of white space alone don't count. Texts of fewer
    lines and null texts stay as they are; a text whose lines all go becomes empty. Rows that share
    id and text are one document: they get the same result. A null id sorts first. All columns
    are kept; ``n_lines`` and ``n_removed_lines`` come back in place of any of that name.
    """
    spans = repeated_line_spans(docs, text_col, id_col, window).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("__s"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__r"), F.col(id_col).alias("__k"), F.xxhash64(text_col).alias("__t"))
    both = rows.join(spans, F.col("__k").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__h")), "left")
    both = both.withColumn("__l", F.split(F.col(f"__r.{text_col}"), "\n", -1)).withColumn("__n", F.coalesce(F.size("__l"), F.lit(0)))
    kept = F.expr(
        "array_join(flatten(transform(sequence(0, size(__s)), k -> slice(__l, if(k = 0, 0, __s[k - 1].e) + 1, "
        "if(k = size(__s), __n, __s[k].s) - if(k = 0, 0, __s[k - 1].e)))), '\\n')"
    )
    removed = F.expr("aggregate(__s, 0, (t, x) -> t + x.e - x.s)")
    text = F.when(F.col("__s").isNull(), F.col(f"__r.{text_col}")).otherwise(kept)
    columns = [text.alias(c) if c == text_col else F.col(f"__r.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    return both.select(*columns, F.greatest(F.col("__n"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed_lines"))
