"""Operator 4, language identification by compression.

For each language a zstandard raw-content dictionary is cut from a bounded sample of its labelled texts. A text is lower-cased and
compressed with every dictionary, block by block over its whole length; the language with the fewest bytes wins. A text is rejected if it
has no letter, if two languages tie, or if the runner-up needs hardly more: the margin, as a share of the best size, below which texts go
is fitted on labelled runs that are in no dictionary, so that about `reject` of them would go.

Texts that are null or have no letter are `und` with score 0. If nothing was learned, all are `und`. Rows with null or repeated doc_id are
predicted like any other; an empty table gives no rows; a very long text counts whole.

score: 1 - 2**-(runner-up minus best, in bytes, over 2), near 1 for a clear winner and 0 for a tie; 1 if only one language was learned."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, free_names, least_rows, worker_model

_LETTER = regex.compile(r"\p{L}")
LANG = "lang_pred string, score double, rejected boolean"
BLOCK, LEVEL = 4 << 10, 9


@dataclass
class Languages:
    """A dictionary for each language, and the least share of the best size by which the runner-up must be behind."""

    dictionaries: dict[str, bytes]
    margin: float = 0.0


def learn(docs: DataFrame, learn_rows: Column, dictionary_bytes: int = 128 << 10, rows: int = 400, held_back: int = 200, reject: float = 0.0025) -> Languages:
    """Dictionaries of at most dictionary_bytes from `rows` distinct texts of each lang value, and the margin from another `held_back`.

    The sample is bounded by these two counts a language, and exact: the texts with the least hashes, whatever their length. Of each one
    run is taken, from anywhere in it by its hash, as long as the language's texts together need to fill the dictionary. There should be
    few languages, as each text is compressed once for each of them."""
    known = docs.where(learn_rows & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where("text <> ''").withColumn("h", F.xxhash64(F.lit(7), "text"))
    some = least_rows(known.select("lang", "h").distinct(), "lang", "h", rows + held_back)
    least = some.groupBy("lang").agg(F.max("h").alias("most"), F.least(F.count("*"), F.lit(rows)).alias("n")).collect()
    if not least:
        return Languages({})
    bound = known.sparkSession.createDataFrame([(r.lang, r.most, max(400, -(-dictionary_bytes // r.n))) for r in least], "lang string, most long, run long")
    spare = F.greatest(F.length("text") - F.col("run"), F.lit(0)) + 1
    cut = F.expr("substring(text, cast(1 + pmod(xxhash64(h), spare) AS int), cast(run AS int))")
    runs = known.join(F.broadcast(bound), "lang").where("h <= most").withColumn("spare", spare).groupBy("lang", "h").agg(F.min(cut).alias("run")).orderBy("lang", "h").collect()
    pool: dict[str, list[bytes]] = {}
    for r in runs:
        pool.setdefault(r.lang, []).append(r.run.lower().encode())
    out = {}
    for lang, texts in sorted(pool.items()):
        whole = b"\n".join(texts[:rows])[:dictionary_bytes]
        out[lang] = whole + b" " * max(0, 8 - len(whole))
    ways = compressors(Languages(out))
    gaps = [(size[at[1]] - size[at[0]]) / size[at[0]] for texts in pool.values() for t in texts[rows:] if len(out) > 1 and len(t) > 300 for size, at in [measured(t, ways)]]
    return Languages(out, float(np.quantile(gaps, reject)) if len(gaps) >= 1 / reject / 4 else 0.0)


def compressors(model: Languages) -> list:
    import zstandard

    out = []
    for name in sorted(model.dictionaries):
        d = zstandard.ZstdCompressionDict(model.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
    return out


def measured(raw: bytes, ways: list) -> tuple[list[int], list[int]]:
    """The size of a text with each dictionary, and the dictionaries from the smallest size on (ties in their order)."""
    sizes = [0] * len(ways)
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        for k, z in enumerate(ways):
            sizes[k] += len(z.compress(part))
    return sizes, sorted(range(len(ways)), key=lambda k: (sizes[k], k))


def predicted(text: str | None, names: list[str], ways: list, margin: float) -> tuple[str, float, bool]:
    if not text or not ways or not _LETTER.search(text):
        return "und", 0.0, True
    sizes, order = measured(text.lower().encode(), ways)
    best = order[0]
    if len(order) == 1:
        return names[best], 1.0, False
    gap = sizes[order[1]] - sizes[best]
    return names[best], 1.0 - 2.0 ** (-min(gap, 2000) / 2), gap < 1 or gap < margin * sizes[best]


def predictor(model: Languages):
    """A column function from text to struct(lang_pred, score, rejected)."""
    names, mark = sorted(model.dictionaries), uuid.uuid4().hex

    @F.pandas_udf(LANG)
    def predict(text: pd.Series) -> pd.DataFrame:
        ways = worker_model(("language", mark), lambda: compressors(model))
        return pd.DataFrame([predicted(t, names, ways, model.margin) for t in text], columns=["lang_pred", "score", "rejected"])

    return predict.asNondeterministic()  # computed once, even where its fields are used twice


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row; learns from the rows whose fold of 4 is not 2."""
    held = fold(F.col("doc_id"), 4) == 2
    udf = predictor(learn(docs, ~held))
    return docs.select("doc_id", held.alias("held_out"), udf(F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not rejected."""
    (p,) = free_names(docs, "__p")
    udf = predictor(learn(docs, fold(F.col("doc_id"), 4) != 2))
    return docs.withColumn(p, udf(F.col("text").cast("string"))).where(~F.col(f"{p}.rejected")).drop(p)
