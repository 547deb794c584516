"""Documents of every awkward kind, and plain-Python versions of what the operators share."""

from __future__ import annotations

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names an operator might use itself
CLASHING = "token string, n long, rank int, rid long, key string, component string, n_words long, shard string, length long, label int"


def fold(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def awkward() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): null and empty texts, odd white space and characters, ties, copies, one very long text."""
    r = random.Random(3)
    vocabulary = [f"w{r.randrange(400)}" for _ in range(300)] + ["The", "don't", "naïve", "café,", "x²", "1234", "--", "…", "日本語"]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = prose(120)
    changed = base.split(" ")
    changed[60] = "other"
    half = base.split(" ")[:60] + prose(60).split(" ")
    texts = [
        None, "", " ", "\n\t \x0b\x0c\r", "one", "one two three four", "One  two\tTHREE four", base, base, base.upper(), " ".join(changed), " ".join(half),
        "a b  c d\x1ce\x85f", "tab\ttab\n\n\nlines  \r\n end ", "<|endoftext|> inside <|endoftext|>", "\u0000\u0001 control", "é" * 50,
        "12345 67890 1,234.56", "it's we'll THEY'RE o'clock", "𝔘𝔫𝔦 😀😀 👩‍👩‍👧", "word " * 300, "\n".join(["same line here"] * 20 + ["other"]), prose(50), prose(49), prose(20000), "z" * 5000, "#*$%&|<> ## $", "?!.,;:", "क्षत्रिय ไทย ไทย",
    ]
    rows = [(10 + 3 * k, t, ["en", "de", "fr", "es", None][k % 5], "web" if k % 3 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(200 + k, prose(30 + 7 * k), "en" if k % 2 else "de", "web", 1) for k in range(40)]
    return rows


def repeated() -> list[tuple]:
    """awkward() with null and repeated ids."""
    rows = awkward()
    return rows + [(None, rows[7][1], "en", None, 1), (None, None, None, None, None), rows[7], rows[7], (rows[7][0], "another text for the same id", "en", "web", 3)]


def frame(spark, rows, extra: bool = True):
    """Rows as documents; with extra columns whose names clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        for field in CLASHING.split(", "):
            name, kind = field.split(" ")
            df = df.withColumn(name, F.lit("7").cast(kind))
    return df
