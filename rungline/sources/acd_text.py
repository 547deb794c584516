"""Records of a binary project's unnamed table: Structured Text, ordered lists of ids, and the safety tag map.

One pass over the table makes rows; how they hang together (routine, its documents, the accepted one of them, its lines) is joins. Of
records with the same id the last counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import acd

#: The record types, by the low half of the number at 22, and the length that each needs.
RECORDS = {0x07D1: ("line", 32), 0x07D2: ("document", 32), 0x07D3: ("state", 42), 0x07D5: ("routine", 40), 0x09C5: ("list", 32), 0x089B: ("map", 34)}
ACCEPTED = 1  # the state of the document that the controller runs


def counted_text(b: bytes, at: int) -> tuple[str, int] | None:
    """A text with its length before it (FF FE FF, then one, two or four bytes), and where it ends; null if there is none."""
    if at + 4 > len(b) or bytes(b[at : at + 3]) != b"\xff\xfe\xff":
        return None
    size, at = b[at + 3], at + 4
    for full, width in ((0xFF, 2), (0xFFFF, 4)):
        if size == full:
            if at + width > len(b):
                return None
            size, at = int.from_bytes(b[at : at + width], "little"), at + width
    stop = min(len(b), at + 2 * size)
    part = bytes(b[at:stop])
    return part[: len(part) // 2 * 2].decode("utf-16-le", errors="replace"), stop


def id_list(b: bytes, at: int) -> list[int]:
    """The ids after their count, as far as the record goes."""
    n = int.from_bytes(b[at : at + 2], "little")
    return [int.from_bytes(b[k : k + 4], "little") for k in range(at + 2, min(at + 2 + 4 * n, len(b) - 3), 4)]


def unnamed(members: DataFrame) -> DataFrame:
    """project, at, kind, id, key, state, ids, text, other: the records of the kinds above."""

    def rows(dat):
        for at, _, r in acd.dat_records(dat):
            kind, least = RECORDS.get(int.from_bytes(r[22:26], "little") & 0xFFFF, (None, 0)) if len(r) >= 26 else (None, 0)
            if kind is None or len(r) < least:
                continue
            text = counted_text(r, 30) if kind in ("line", "map") else None
            other = counted_text(r, text[1]) if kind == "map" and text else None
            if kind == "line" and text is None:
                continue
            state = int.from_bytes(r[38:42], "little") if kind == "state" else None
            ids = id_list(r, 38 if kind == "routine" else 30) if kind in ("document", "routine", "list") else None
            yield at, kind, int.from_bytes(r[14:18], "little"), int.from_bytes(r[18:22], "little"), state, ids, text and text[0], other and other[0]

    return acd._from(members, "nameless.dat", "at long, kind string, id long, key long, state long, ids array<long>, text string, other string", rows)


def _last(records: DataFrame, kind: str, by: str, what: str, name: str) -> DataFrame:
    return records.where(F.col("kind") == kind).groupBy("project", F.col(by).alias(name)).agg(F.max_by(what, "at").alias(what))


def st_documents(records: DataFrame) -> DataFrame:
    """project, owner (a routine's id), document, ids (its lines), pending: the accepted document of each routine, else its first; pending if
    another one has lines. A routine without documents, or whose document isn't stored, has no row."""
    lists = _last(records, "routine", "id", "ids", "owner").select("project", "owner", F.posexplode("ids").alias("ord", "document"))
    states = _last(records, "state", "key", "state", "document")
    stored = _last(records, "document", "id", "ids", "document")
    at = lists.join(states, ["project", "document"], "left").join(stored, ["project", "document"], "left")
    worse = F.coalesce(F.col("state") != ACCEPTED, F.lit(True))
    found = at.groupBy("project", "owner").agg(
        F.min_by(F.struct("document", "ids"), F.struct(worse, "ord")).alias("d"),
        F.collect_set(F.when(F.size("ids") > 0, F.col("document"))).alias("full"),
    )
    pending = F.exists("full", lambda x: x != F.col("d.document"))
    return found.where("d.ids IS NOT NULL").select("project", "owner", "d.document", "d.ids", pending.alias("pending"))


def st_lines(records: DataFrame) -> DataFrame:
    """project, owner, n, txt, missing: the lines of each routine's document in order; a line that isn't stored is empty."""
    rows = st_documents(records).select("project", "owner", F.posexplode("ids").alias("n", "line"))
    texts = _last(records, "line", "key", "text", "line")
    return rows.join(texts, ["project", "line"], "left").select("project", "owner", F.col("n").cast("long").alias("n"), F.coalesce("text", F.lit("")).alias("txt"), F.col("text").isNull().alias("missing"))


def routine_lines(records: DataFrame, routines: DataFrame, comps: DataFrame) -> DataFrame:
    """project, program, aoi, routine, n, txt, missing, unresolved: text with names in place of ids. routines: acd.routines."""
    own = routines.where("type = 'ST'").select("project", "program", "aoi", "routine", F.col("id").alias("owner"))
    named = acd.resolved(st_lines(records), comps, ["project", "owner", "n"])
    return named.join(own, ["project", "owner"]).select("project", "program", "aoi", "routine", "n", "txt", "missing", "unresolved")


def ordered_lists(records: DataFrame) -> DataFrame:
    """project, at, ids: the ordered lists of object ids."""
    return records.where("kind = 'list'").select("project", "at", "ids")


def safety_map(records: DataFrame, comps: DataFrame) -> DataFrame:
    """project, at, standard, safety: pairs of tags, by name; records that lack either text are left out."""
    pairs = records.where("kind = 'map' AND text <> '' AND other <> ''").select("project", "at", F.col("text").alias("standard"), F.col("other").alias("safety"))
    for c in ("standard", "safety"):
        pairs = acd.resolved(pairs, comps, ["project", "at"], c).drop("unresolved")
    return pairs.select("project", "at", "standard", "safety")
