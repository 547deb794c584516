"""Operator 11, fill-in-middle by escaped marker injection (DataFrame functions only).

The text's own delimiter characters are escaped, regexp_replace appends the delimiter after every unit, the delimiters are counted, and
substring_index takes prefix, middle and suffix as ranked parts, which are then freed of delimiters, unescaped and put together again.
Where a text is cut, and in which form it leaves, comes from a hash of a seed and its doc_id alone, so rows may be made again anywhere.

A null text counts as empty and a null doc_id as an empty one in the hash. Empty texts, and texts that hold a marker themselves, stay
plain. Rows with repeated ids are cut at the same unit numbers; a very long text is one row like any other; an empty table gives no rows;
other columns, whatever their names, are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT, ESCAPE = "\u001f", "\u001e"
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(CUT), F.lit(ESCAPE + "1"))


def _unescaped(part: Column) -> Column:
    """A part of a marked text as it stood in the text."""
    bare = F.replace(part, F.lit(CUT), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(CUT)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _ranked(text: str, count: str) -> Column:
    return F.expr(f"substring_index({text}, '\\u001f', cast({count} AS int))")


def fill_in_middle(docs: DataFrame, rate: int = 100, suffix_first: int = 50, seed: str = "7", unit: str = LINES) -> DataFrame:
    """doc_id, n, form, prefix, middle, output for each row: `rate` in a hundred texts are cut, `suffix_first` in a hundred of these lead
    with the suffix. `unit` is a Java pattern whose matches, left to right, make up the whole text. Prefix and middle are null if plain."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    df = docs.select("doc_id", text.alias("text"), digest.alias("digest"))
    df = df.withColumn("marked", F.regexp_replace(_escaped(F.col("text")), unit, "$0" + CUT))
    df = df.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(CUT), F.lit("")))).cast("long"))
    df = df.withColumns({"x": part(0) % (F.col("n") + 1), "y": part(1) % (F.col("n") + 1)})
    held = [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("text") == "") | held[0] | held[1] | held[2] | (part(2) % 100 >= rate)
    form = F.when(plain, "plain").when(part(3) % 100 < suffix_first, "spm").otherwise("psm")
    df = df.select("doc_id", "text", "marked", "n", form.alias("form"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    df = df.withColumn("head", _ranked("marked", "b"))  # the first b units; their last delimiter is gone
    cut = F.col("form") != "plain"
    df = df.select(
        "doc_id", "text", "n", "form",
        F.when(cut, _unescaped(_ranked("head", "a"))).alias("prefix"),
        F.when(cut, _unescaped(_ranked("head", "a - b"))).alias("middle"),
        F.when(cut, _unescaped(_ranked("marked", "b - n - 1"))).alias("suffix"),
    )
    first = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    second = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", first).when(F.col("form") == "spm", second).otherwise(F.col("text"))
    return df.select("doc_id", "n", "form", "prefix", "middle", output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again, from an output and its form: a text that was cut holds no marker, so each marker's only occurrence is the one put in."""
    head, middle = f"substring_index({output}, '{MIDDLE}', 1)", f"substring_index({output}, '{MIDDLE}', -1)"
    psm = f"concat(substring(substring_index({head}, '{SUFFIX}', 1), {len(PREFIX) + 1}), {middle}, substring_index({head}, '{SUFFIX}', -1))"
    spm = f"concat(substring_index({head}, '{PREFIX}', -1), {middle}, substring(substring_index({head}, '{PREFIX}', 1), {len(SUFFIX) + 1}))"
    return F.expr(f"CASE {form} WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE {output} END")
