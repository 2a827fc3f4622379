"""Readers of documentation artifacts: XML records, JSON documents, GML graphs, front matter, help entries, source files.

Files are read as whole rows by Spark's own readers, so any store that Spark knows works; parsing of mixed content runs in
mapInPandas with the standard XML parser, one file at a time.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITY_SCHEMA = (
    "compound string, member string, kind string, name string, definition string, argsstring string, "
    "file string, line int, decl_file string, decl_line int, body_file string, body_start int, body_end int, "
    "brief string, details string, params map<string,string>, returns string, "
    "refs array<struct<tag:string,refid:string>>, parent string"
)
CODELINE_SCHEMA = "file string, line int, owner string, refs array<string>"


def _text(node: ET.Element | None, skip: tuple[str, ...] = ()) -> str:
    """The text of a mixed-content element, paragraphs on lines of their own, without the skipped elements."""
    if node is None:
        return ""
    out: list[str] = [node.text or ""]
    for child in node:
        if child.tag not in skip:
            inner = _text(child, skip)
            out.append(inner + ("\n" if child.tag == "para" else ""))
        out.append(child.tail or "")
    return "".join(out)


def _description(node: ET.Element | None) -> tuple[str, dict[str, str], str]:
    """(prose, params, returns) of a detailed description."""
    params: dict[str, str] = {}
    returns: list[str] = []
    if node is None:
        return "", params, ""
    for item in node.iter("parameteritem"):
        names = [(_text(n)).strip() for n in item.iter("parametername")]
        for n in names:
            params[n] = _text(item.find("parameterdescription")).strip()
    for sect in node.iter("simplesect"):
        if sect.get("kind") == "return":
            returns.append(_text(sect).strip())
    return _text(node, ("parameterlist", "simplesect")).strip(), params, "\n".join(returns)


def _int(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isdigit() else None


def _location(node: ET.Element) -> dict:
    """File, declaration and body; -1 as body end is the start line, as body start no body."""
    at = node.find("location")
    if at is None:
        return {}
    start, end = _int(at.get("bodystart")), _int(at.get("bodyend"))
    body = start is not None and start > 0
    return {
        "file": at.get("file"), "line": _int(at.get("line")), "decl_file": at.get("declfile"), "decl_line": _int(at.get("declline")),
        "body_file": at.get("bodyfile") if body else None, "body_start": start if body else None,
        "body_end": (end if end and end > 0 else start) if body else None,
    }


_INNER = ("memberdef", "sectiondef", "programlisting")


def _refs(node: ET.Element) -> list[dict]:
    """Every descendant with a refid, not inside members of its own or listings; plain ones as their tag, others as ref."""
    found, stack = [], list(node)
    while stack:
        child = stack.pop(0)
        if child.tag in _INNER:
            continue
        if child.get("refid"):
            found.append({"tag": child.tag, "refid": child.get("refid")})
        stack += list(child)
    return found


def _entity(node: ET.Element, compound: str, member: str | None, name_tag: str) -> dict:
    details, params, returns = _description(node.find("detaileddescription"))
    return {
        "compound": compound, "member": member, "kind": node.get("kind"), "name": (node.findtext(name_tag) or "").strip(),
        "definition": node.findtext("definition"), "argsstring": node.findtext("argsstring"),
        "brief": _text(node.find("briefdescription")).strip(), "details": details, "params": params, "returns": returns,
        "refs": _refs(node), "parent": compound if member else None,
    } | _location(node)


def parse_compound(raw: bytes) -> list[dict]:
    """A file's compound and its members without friends; a group without a location spans its members' lines in its main file."""
    out = []
    for compound in ET.fromstring(raw).iter("compounddef"):
        cid = compound.get("id", "")
        members = []
        for m in compound.iter("memberdef"):
            if m.get("kind") != "friend":
                mid = m.get("id", "")
                members.append(_entity(m, cid, mid[len(cid) + 2 :] if mid.startswith(f"{cid}_1") else mid, "name"))
        head = _entity(compound, cid, None, "compoundname")
        if head["kind"] == "group" and not head.get("file") and members:
            files: dict[str, list[int]] = {}
            for m in members:
                if m.get("file") and m.get("line"):
                    files.setdefault(m["file"], []).append(m["line"])
            if files:
                main = min(files, key=lambda f: (-len(files[f]), f))
                head |= {"file": main, "line": min(files[main]), "body_file": main, "body_start": min(files[main]), "body_end": max(files[main])}
        out += [head, *members]
    return out


def read_xml_entities(spark: SparkSession, path: str) -> DataFrame:
    """One row per compound and member of the XML files in a folder, without the index (SRC1-SRC4)."""
    names = [f.strip().split(" ")[0] for f in ENTITY_SCHEMA.replace("array<struct<tag:string,refid:string>>", "x").replace("map<string,string>", "x").split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for raw in pdf["content"] for r in parse_compound(bytes(raw))]
            out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)
            for c in ("line", "decl_line", "body_start", "body_end"):
                out[c] = out[c].astype("Int32")
            yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return files.where(~F.endswith("path", F.lit("/index.xml"))).select("content").mapInPandas(parse, ENTITY_SCHEMA)


def read_code_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, owner, refs of the listings: a line's owner is the last line-level reference up to it (SRC5)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf["content"]:
                for compound in ET.fromstring(bytes(raw)).iter("compounddef"):
                    for line in compound.iter("codeline"):
                        rows.append((compound.get("id"), _int(line.get("lineno")), line.get("refid"), [r.get("refid") for r in line.iter("ref") if r.get("refid")]))
            yield pd.DataFrame(rows, columns=["file", "line", "owner", "refs"]).astype({"line": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    lines = files.where(~F.endswith("path", F.lit("/index.xml"))).select("content").mapInPandas(parse, CODELINE_SCHEMA)
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("owner", F.last("owner", ignorenulls=True).over(w))


def structure_profile(spark: SparkSession, path: str) -> DataFrame:
    """tag path, files and occurrences of the XML files in a folder (NB1)."""

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf["content"]:
                counts: dict[str, int] = {}
                stack = [(ET.fromstring(bytes(raw)), "")]
                while stack:
                    node, above = stack.pop()
                    here = f"{above}/{node.tag}"
                    counts[here] = counts.get(here, 0) + 1
                    stack += [(c, here) for c in node]
                rows += counts.items()
            yield pd.DataFrame(rows, columns=["path", "n"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path).select("content")
    return files.mapInPandas(paths, "path string, n long").groupBy("path").agg(F.count("*").alias("files"), F.sum("n").alias("n"))


DOCUMENT_TYPE = (
    "struct<brief:string,details:string,params:map<string,string>,returns:string,tparams:map<string,string>,throws:string,notes:string,"
    "rationale:string,state:string,cid:string,mid:string,etype:string,kind:string,name:string,qualified_name:string,definition:string,"
    "argsstring:string,prompt:string,response:string,usages:map<string,string>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """compound, signature and the fields of each document in a folder of JSON files, one file per compound (SRC8).

    A file that is no JSON object is skipped; a missing state is extracted_summary.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("compound"), F.from_json("value", f"map<string,{DOCUMENT_TYPE}>").alias("docs")
    )
    rows = files.where("docs is not null").select("compound", F.explode("docs").alias("signature", "doc")).where("doc is not null")
    return rows.select("compound", "signature", "doc.*").withColumn("state", F.coalesce("state", F.lit("extracted_summary")))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """An array of records in one file, or one record a line (SRC6)."""
    return spark.read.json(path, multiLine=True)


def read_capability_definitions(spark: SparkSession, path: str) -> DataFrame:
    """capability, type, description, stability, functions of a JSON map by name (SRC9)."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<type:string,desc:string,description:string,stability:string,functions:array<string>,locked:array<string>>>"
    rows = text.select(F.explode(F.from_json("value", kind)).alias("capability", "d"))
    return rows.select(
        "capability", "d.type", F.coalesce("d.description", "d.desc").alias("description"), "d.stability", F.coalesce("d.functions", "d.locked").alias("functions")
    )


def read_capability_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(capability edges, entry points) of a capability graph file (SRC9)."""
    kind = (
        "struct<dependencies:map<string,map<string,struct<call_count:int,edge_type:string,in_dag:boolean>>>,"
        "entry_points:map<string,struct<type:string,capabilities:array<string>,earliest_wave:int>>>"
    )
    g = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("g"))
    deps = g.select(F.explode("g.dependencies").alias("source_cap", "targets")).select("source_cap", F.explode("targets").alias("target_cap", "e")).select("source_cap", "target_cap", "e.*")
    entries = g.select(F.explode("g.entry_points").alias("name", "e")).select("name", "e.*")
    return deps, entries


def check_files(spark: SparkSession, folder: str, required: list[str]) -> None:
    """Raises unless every named file is there and not empty (SRC10)."""
    jvm = spark.sparkContext._jvm
    for name in required:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise FileNotFoundError(f"{folder}/{name}")
        if fs.getFileStatus(path).isFile() and not fs.getFileStatus(path).getLen():
            raise ValueError(f"{folder}/{name} is empty")


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, name, kind, type; edges: src, dst, relationship) of a GML file (SRC7)."""
    blocks = spark.read.text(path, wholetext=True)
    body = r'((?:[^\[\]"]|"[^"]*")*)'

    def field(c: Column, name: str) -> Column:
        quoted = F.regexp_extract(c, rf'(?m)^\s*{name}\s+"([^"]*)"', 1)
        plain = F.regexp_extract(c, rf"(?m)^\s*{name}\s+([^\s\"]+)", 1)
        return F.nullif(F.when(quoted != "", quoted).otherwise(plain), F.lit(""))

    nodes = blocks.select(F.explode(F.regexp_extract_all("value", F.lit(rf"\bnode\s*\[{body}\]"), 1)).alias("b")).select(
        field(F.col("b"), "id").cast("long").alias("id"), *[field(F.col("b"), c).alias(c) for c in ("label", "name", "kind", "type")]
    )
    edges = blocks.select(F.explode(F.regexp_extract_all("value", F.lit(rf"\bedge\s*\[{body}\]"), 1)).alias("b")).select(
        field(F.col("b"), "source").cast("long").alias("s"), field(F.col("b"), "target").cast("long").alias("t"), F.coalesce(field(F.col("b"), "key"), field(F.col("b"), "type")).alias("relationship")
    )
    a, b = nodes.select(F.col("id").alias("s"), F.col("label").alias("src")), nodes.select(F.col("id").alias("t"), F.col("label").alias("dst"))
    return nodes, edges.join(a, "s").join(b, "t").select("src", "dst", "relationship")


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """id, name, kind, layer, parent, depends_on, depended_on_by, text, ord of Markdown files with front matter and an id (SRC11)."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.input_file_name().alias("file"), "value")
    head = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    rows = files.select("file", head.alias("head"), F.regexp_replace("value", r"(?s)\A---\s*\n.*?\n---\s*\n?", "").alias("text"))
    scalar = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("head", rf"(?m)^{k}:[ \t]*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(""))

    def listed(k: str) -> Column:
        inline = F.regexp_extract("head", rf"(?m)^{k}:[ \t]*\[(.*)\]", 1)
        block = F.regexp_extract("head", rf"(?m)^{k}:[ \t]*\n((?:[ \t]*-.*(?:\n|$))*)", 1)
        items = F.when(inline != "", F.split(inline, ",")).otherwise(F.split(block, "\n"))
        return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^-\\s*|^[\"']|[\"']$", "")), lambda x: x != "")

    out = rows.select("file", *[scalar(k).alias(k) for k in ("id", "name", "kind", "layer", "parent")], listed("depends_on").alias("depends_on"), listed("depended_on_by").alias("depended_on_by"), "text")
    return out.where("id is not null").withColumn("length", F.length("text"))


def read_help_entries(spark: SparkSession, path: str) -> DataFrame:
    """position, keywords, category, level, text (colour codes stripped), length of a JSON array of help entries (SRC12)."""
    kind = "array<struct<keywords:string,category:string,level:int,text:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)).alias("position", "e")).select("position", "e.*")
    return rows.withColumn("length", F.length("text")).withColumn("text", F.regexp_replace("text", r"\{[A-Za-z]", ""))


def source_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text of source files."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "text")).select("file", (F.col("i") + 1).alias("line"), "text")


def slice_source(entities: DataFrame, lines: DataFrame, key: str = "entity_id", before: int = 0, after: int = 0) -> DataFrame:
    """key, source_text of body_start..body_end with context lines clamped to the file; an inverted range raises (SRC13, FN25)."""
    start, end = F.col("body_start"), F.col("body_end")
    checked = F.when((start <= end) & (start > 0), start).otherwise(F.raise_error(F.concat(F.lit("bad range: "), F.col(key).cast("string"))).cast("int"))
    wanted = entities.where(start.isNotNull() & end.isNotNull()).select(key, F.col("body_file").alias("file"), checked.alias("s"), end.alias("e"))
    hit = wanted.join(lines, "file").where((F.col("line") >= F.greatest(F.col("s") - before, F.lit(1))) & (F.col("line") <= F.col("e") + after))
    return hit.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("source_text"))


def preceding_comments(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, line, comment: the comment lines straight above a line, blanks skipped, up to the first code line (FN22).

    A comment line starts with //, or with /*, or lies in a block that no code stands before. Lines that are wanted bound each
    other: a comment starts no higher than the wanted line before. Lines without a comment above have no row. Windows over a
    file number the stretches between code lines, so a wanted line meets its own stretch and not the whole file.
    """
    t = F.trim("text")
    above = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    opens, closes, starts = t.rlike(r"/\*(?!.*\*/)"), F.contains(t, F.lit("*/")), t.startswith("/*")
    # 0: closed, 1: in a comment block, 2: in a block that started after code
    event = F.when(t.startswith("//") & ~closes, F.lit(None)).when(opens, F.when(starts, 1).otherwise(2)).when(closes, 0)
    marked = lines.select("file", "line", "text", F.coalesce(F.last(event, ignorenulls=True).over(above), F.lit(0)).alias("block"))
    whole = ~closes | t.endswith("*/")
    comment = F.when(F.col("block") == 1, whole).when(F.col("block") == 2, F.lit(False)).otherwise(t.startswith("//") | (starts & whole))
    code = (t != "") & ~comment
    placed = marked.withColumn("code", code).withColumn("stretch", F.coalesce(F.sum(F.col("code").cast("int")).over(above), F.lit(0)))
    order = Window.partitionBy("file").orderBy("line")
    at = wanted.select("file", "line").distinct().withColumn("floor", F.coalesce(F.lag("line").over(order), F.lit(0)))
    at = at.join(placed.select("file", "line", "stretch"), ["file", "line"])
    text = placed.where(~F.col("code") & (t != "")).select("file", "stretch", F.col("line").alias("l"), "text")
    hit = at.join(text, ["file", "stretch"]).where((F.col("l") < F.col("line")) & (F.col("l") >= F.col("floor")))
    return hit.groupBy("file", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "text"))), lambda x: x["text"]), "\n").alias("comment"))


def split_entity_id(c: Column) -> Column:
    """struct(compound, member) of `compound_member`, the member a hash of two letters and thirty or more hex digits."""
    pattern = r"^(.*)_([0-9a-z]{2}[0-9a-f]{30,})$"
    hit = F.regexp_extract(c, pattern, 1)
    return F.struct(F.when(hit != "", hit).otherwise(c).alias("compound"), F.nullif(F.regexp_extract(c, pattern, 2), F.lit("")).alias("member"))


def split_location(c: Column) -> Column:
    """struct(file, line, column, end_line) of `file:line[:column]` or `file:line-end`."""
    p = r"^(.*?):(\d+)(?::(\d+)|-(\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return F.struct(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), part(4).cast("int").alias("end_line"))


def unused_files(found: DataFrame, used: DataFrame) -> DataFrame:
    """Listed files that no compilation used (SRC15); both: path."""
    return found.select("path").distinct().join(used.select("path"), "path", "left_anti")


def reply_object(c: Column, schema: str) -> Column:
    """The JSON object of a model's reply, fenced or bare (EM4, NB10)."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(bare), schema)


def reply_lines(c: Column) -> Column:
    """map<name, text> of `name: text` lines, the fallback of a reply without JSON (NB10)."""
    rows = F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit(": ")))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, ": ", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, F.lit(": ")) + 2)).alias("value")))
    return F.map_from_entries(F.array_distinct(pairs))
