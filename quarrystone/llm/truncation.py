"""Problem 10: texts cut at a field limit or in mid-transfer.

Per source, the lengths of all different texts, in characters and in bytes, are
counted; a limit is the tallest bar at the top of a source's histogram if it holds
many more texts than the lengths below it lead to expect (in bytes the three
lengths under it count too, since a character is not split) and next to none lie
above it (texts to which white space was added later). A text at the limit is cut
if it does not end as complete texts do, or ends in an added ellipsis (then also
up to a hundredth below the limit). Away from a limit, a text that ends within a
word or sentence was cut in mid-transfer.

Complete texts end with terminal punctuation, or with a line of a form that
complete texts of this corpus end with (list items, table rows, signatures).
These forms are learned: the form of a last line is what it starts with and what
follows its last separator, digits masked; a form counts as complete if it ends
at least FORM_SHARE of all different texts, FORM_LEAST at least, below the limits. A
cut leaves the reader somewhere in a line, so any single remnant is far rarer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.sources.tables import cut

_TRAIL = " \t\r\n\x0b\x0c\u00a0\u2002\u2003\u2009\u200b\u3000\ufeff"
_CLOSED = r"[.。．!！?？…][)\]}\"'”’»」』]*$"
_ELLIPSIS = r"(\.\.\.|…)$"
FORM_SHARE, FORM_LEAST = 1 / 2000, 2


def ending_form(text: Column) -> Column:
    """The form of a text's last line: its leading marker, label or word, and what follows its last ';', ':', '|' or '=' (that sign itself if nothing does).

    Lower case, whole numbers as one 0, decimals by their number of digits, no signs: '- Ce: log D = -1.98' is '- … 0.00'. NULL for NULL.
    """
    last = F.trim(F.substring_index(F.rtrim(text, F.lit(_TRAIL)), "\n", -1))
    lead = F.regexp_replace(F.regexp_extract(last, r"^(\p{L}+:|[^\p{L}\p{N}\s]+|[0-9]|\p{L}+)", 1), "[0-9]", "0")
    tail = F.when(last.rlike("[;:|=]$"), F.right(last, F.lit(1))).otherwise(F.regexp_extract(last, r"(?s)^(?:.*[;:|=])?([^;:|=]*)$", 1))
    masked = F.regexp_replace(F.regexp_replace(F.trim(F.lower(tail)), "[0-9]", "0"), "(^|[^.0])0+", "$10")
    return F.concat(lead, F.lit(" … "), F.regexp_replace(masked, "[-−+]0", "0"))


def _measured(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, h, chars, bytes, blank, closed, dots, form) of every row; form only where the text has no terminal punctuation."""
    t = F.col(f"`{text}`")
    end = F.rtrim(t, F.lit(_TRAIL))
    closed = F.coalesce(end.rlike(_CLOSED), F.lit(True))
    return df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.when(t.isNotNull(), F.xxhash64(t)).alias("h"), F.length(t).alias("chars"), F.octet_length(F.rtrim(t, F.lit("�"))).alias("bytes"),
        F.coalesce(end == "", F.lit(True)).alias("blank"), closed.alias("closed"), F.coalesce(end.rlike(_ELLIPSIS), F.lit(False)).alias("dots"), F.when(~closed, ending_form(t)).alias("form"),
    )


def source_limits(measured: DataFrame, least: int = 5, excess: float = 5.0) -> DataFrame:
    """(source, kind, top, n_top): the sources with a spike at their greatest length, kind 'chars' or 'bytes'.

    A spike has at least `least` different texts and `excess` times as many as
    the mean over the fifth of the length range below it.
    """
    texts = measured.where("h IS NOT NULL").select("source", "h", "chars", "bytes").distinct()
    kinds = F.explode(F.array(F.struct(F.lit("chars").alias("kind"), F.col("chars").alias("len"), F.lit(1).alias("slack")), F.struct(F.lit("bytes").alias("kind"), F.col("bytes").alias("len"), F.lit(4).alias("slack"))))
    bars = texts.select("source", kinds.alias("k")).groupBy("source", "k.kind", "k.len", "k.slack").agg(F.count("*").alias("n"))
    each = Window.partitionBy("source", "kind")
    bars = bars.withColumn("longest", F.max("len").over(each)).where(F.col("len") >= 0.8 * F.col("longest"))
    tallest = F.max(F.when(F.col("len") >= 0.95 * F.col("longest"), F.struct("n", "len"))).over(each)
    bars = bars.withColumn("top", tallest["len"])
    high = (F.col("len") > F.col("top") - F.col("slack")) & (F.col("len") <= F.col("top"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    per = bars.groupBy("source", "kind", "top", "slack").agg(total(high).alias("n_top"), total(F.col("len") <= F.col("top") - F.col("slack")).alias("below"), total(F.col("len") > F.col("top")).alias("above"))
    usual = F.col("slack") * F.col("below") / F.greatest(0.2 * F.col("top"), F.lit(1.0))
    return per.where((F.col("n_top") >= least) & (F.col("n_top") >= excess * usual) & (F.col("above") <= 0.1 * F.col("n_top"))).select("source", "kind", "top", "slack", "n_top")


def _with_limits(measured: DataFrame) -> DataFrame:
    """measured with at_limit: whether a text is as long as its source's limit allows."""
    limits = source_limits(measured).groupBy(F.col("source").alias("_s")).agg(F.max(F.when(F.col("kind") == "chars", F.col("top"))).alias("c"), F.max(F.when(F.col("kind") == "bytes", F.col("top"))).alias("b"))
    at = F.coalesce(F.col("chars") >= F.col("c"), F.lit(False)) | F.coalesce(F.col("bytes") > F.col("b") - 4, F.lit(False))
    # White space before an added ellipsis is dropped, so such texts may end a little below the limit.
    near = F.coalesce(F.col("chars") >= 0.99 * F.col("c"), F.lit(False)) | F.coalesce(F.col("bytes") >= 0.99 * F.col("b"), F.lit(False))
    return measured.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("at_limit", at | (F.col("dots") & near)).drop("_s", "c", "b")


def complete_forms(limited: DataFrame, share: float = FORM_SHARE, least: int = FORM_LEAST) -> DataFrame:
    """(form, n_texts): the forms that complete texts without terminal punctuation end with; at most 1 / share of them."""
    below = limited.where("h IS NOT NULL AND NOT at_limit")
    total = below.select("h").distinct().agg(F.count("*")).scalar()
    each = below.where("form IS NOT NULL AND NOT blank").select("form", "h").distinct().groupBy("form").agg(F.count("*").alias("n_texts"))
    return each.where(F.col("n_texts") >= F.greatest(F.lit(least), total * share))


def find_truncated(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, cut, evidence) of every row: evidence is 'limit', 'transfer' or NULL where the text is not cut.

    NULL, empty and blank texts are not cut. Rows of a NULL source form one
    source. Copies of a text count once in histograms and forms. Rows repeated
    under one id stay. An empty table stays empty.
    """
    limited = _with_limits(cut(_measured(df, doc_id, text, source)))  # a few numbers a text, read four times
    forms = F.broadcast(complete_forms(limited).select("form", F.lit(True).alias("known")))  # at most 2,000 rows
    judged = limited.join(forms, "form", "left")
    broken = ~F.col("blank") & ((~F.col("closed") & F.col("known").isNull()) | (F.col("at_limit") & F.col("dots")))
    return judged.select("doc_id", "source", broken.alias("cut"), F.when(broken, F.when(F.col("at_limit"), "limit").otherwise("transfer")).alias("evidence"))


def ending_forms(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(form, n_texts): the learned forms of complete last lines, for review."""
    return complete_forms(_with_limits(_measured(df, doc_id, text, source)))
