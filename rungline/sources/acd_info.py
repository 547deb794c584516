"""The XML indexes in a binary project: identity of the controller, and types, members and tags with their definitions."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from . import acd, l5x

_attr = l5x._attr


def product_name(version: str | None) -> str | None:
    """The product of a version text: it was renamed at 21."""
    m = re.search(r"v?(\d+)\.(\d+)", version or "")
    return f"{'Studio 5000 Logix Designer' if int(m[1]) >= 21 else 'RSLogix 5000'} v{m[1]}.{m[2]}" if m else version


def _quick(data: bytes):
    """(name, description, software, revision, product code) of an identity file; a value is an attribute or a child's text."""
    root = ET.fromstring(acd.xml_text(data).lstrip("﻿"))
    if root.tag != "LogixQuickInfo":
        return []

    def value(node, name):
        if node is None:
            return None
        child = node.find(name)
        return node.get(name) or ((child.text or "").strip() or None if child is not None else None)

    identity = root.find("DeviceIdentity")
    major, code = value(identity, "MajorRevision"), value(identity, "ProductCode")
    revision = f"{major}.{value(identity, 'MinorRevision') or 0}" if major is not None else None
    return [(value(root, "Name") or "", value(root, "Description"), product_name(value(root.find("SWVersion"), "String")), revision, int(code) if code else None)]


def controllers(members: DataFrame) -> DataFrame:
    """project, controller, description, software, revision, product_code; a project without the file is named by its own file's name."""
    found = acd._from(members, "quickinfo.xml", "name string, description string, software string, revision string, product_code long", _quick)
    stem = F.regexp_extract("project", r"([^/\\]*?)(\.[^./\\]*)?$", 1)
    rows = members.select("project").distinct().join(found.hint("merge"), "project", "left")
    return rows.select("project", F.coalesce(F.nullif("name", F.lit("")), stem).alias("controller"), "description", "software", "revision", "product_code")


def elements(members: DataFrame) -> DataFrame:
    """The elements of the tag index, in the columns of l5x.read_elements."""
    names = [f.split(" ")[0] for f in l5x.ELEMENTS.split(", ")][1:]

    def rows(data):
        for r in l5x.elements_of("", acd.xml_text(data).lstrip("﻿"), "LogixTagInfo"):
            r["attrs"], r["texts"] = list(r["attrs"].items()), list(r["texts"].items())
            yield tuple(r[n] for n in names)

    return acd._from(members, "taginfo.xml", l5x.ELEMENTS.split(", ", 1)[1], rows)


def _with_dims(e: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(project, seq) with dims: the sizes above 0 of their dimensions in order, null without any."""
    lists = e.where("element = 'Dimensions'").select("project", F.col("seq").alias("__list"), F.col("parent").alias("seq"))
    sizes = e.where("element = 'Dim'").select("project", F.col("parent").alias("__list"), "ord", F.expr("try_cast(attrs['Size'] AS int)").alias("size")).where("size > 0")
    dims = sizes.join(lists, ["project", "__list"]).groupBy("project", "seq").agg(F.array_sort(F.collect_list(F.struct("ord", "size")))["size"].alias("dims"))
    return rows.join(dims, ["project", "seq"], "left")


def _words(c):
    return F.nullif(F.trim(F.col("texts")[c]), F.lit(""))


def _types(e: DataFrame) -> DataFrame:
    return e.where("element = 'DataType'").select("project", F.col("seq").alias("__t"), _attr("Name").alias("type_name"), _words("Description").alias("description"))


def members_of_types(e: DataFrame) -> DataFrame:
    """project, type_name, ord, name, data_type, dims, hidden, bit, target: members of types. A packed BOOL at an offset and bit is a BIT of the
    hidden SINT that lies at offset + bit / 8 (of several the last), at the bit's rest by 8; without such a host it stays a BOOL."""
    lists = e.where("element = 'Members'").select("project", F.col("seq").alias("__l"), F.col("parent").alias("__t"))
    number = lambda c: F.expr(f"try_cast(attrs['{c}'] AS int)").alias(c.lower())
    m = e.where("element = 'Member'").select("project", "seq", F.col("parent").alias("__l"), "ord", _attr("Name").alias("name"), F.coalesce(_attr("DataType"), F.lit("")).alias("data_type"), (F.coalesce(_attr("Hidden"), F.lit("")) == "true").alias("hidden"), number("Bit"), number("Offset"))
    m = _with_dims(e, m.join(lists, ["project", "__l"]).join(_types(e).drop("description"), ["project", "__t"]))
    host = m.where("hidden AND data_type = 'SINT' AND offset IS NOT NULL").groupBy("project", "__t", F.col("offset").alias("__at")).agg(F.max_by("name", "ord").alias("__host"))
    packed = F.col("data_type").isin("BOOL", "BIT") & F.col("bit").isNotNull()
    m = m.withColumn("__at", F.when(packed, F.col("offset") + F.expr("bit div 8").cast("int"))).join(host, ["project", "__t", "__at"], "left")
    there = F.col("__host").isNotNull()
    return m.select("project", "type_name", "ord", "name", F.when(there, "BIT").otherwise(F.col("data_type")).alias("data_type"), "dims", "hidden", F.when(there, F.col("bit") % 8).otherwise(F.col("bit")).alias("bit"), F.col("__host").alias("target"))


def data_types(e: DataFrame, comps: DataFrame, template: DataFrame | None = None) -> DataFrame:
    """project, name, kind: module types have a colon in their name; builtin ones are known or stand in the empty project inside the file
    (`template`, its object table); types of user-defined instructions are left out."""
    kinds = _types(e).withColumnRenamed("type_name", "name")
    aois = acd.members_of(comps, "RxUDIDefinitionCollection", "ProgramOrAoi").select("project", "name")
    first = kinds.join(aois, ["project", "name"], "left_anti")
    known = F.col("name").isin(*tables.BUILTIN_TYPES)
    if template is not None:
        lists = template.where("name = 'RxDataTypeCollection'").groupBy("project").agg(F.min("id").alias("parent"))
        given = template.join(lists, ["project", "parent"]).select("project", "name").distinct().withColumn("__given", F.lit(True))
        first = first.join(given, ["project", "name"], "left")
        known = known | F.coalesce("__given", F.lit(False))
    return first.select("project", "name", F.when(F.col("name").contains(":"), "module").when(known, "builtin").otherwise("udt").alias("kind"))


def tags(e: DataFrame) -> DataFrame:
    """project, scope ('' for the controller), name, data_type, dims, description, produced."""
    rows = e.where("element = 'Tag'").select("project", "seq", F.coalesce("program", F.lit("")).alias("scope"), _attr("Name").alias("name"), F.coalesce(_attr("DataType"), F.lit("")).alias("data_type"), _words("Description").alias("description"), (F.coalesce(_attr("Produced"), F.lit("")) == "true").alias("produced"))
    return _with_dims(e, rows).select("project", "scope", "name", "data_type", "dims", "description", "produced")
