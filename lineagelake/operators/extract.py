"""Extraction of keys, annotations, headings and image references from texts."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import yaml
from ..functions.text import REDACTED, image_reference, slug, wiki_links, without_code
from ..plans.lineage import settle


def json_keys(rows: DataFrame, ident: str, column: str) -> DataFrame:
    """``file, key, value`` of the leaves of JSON objects at any depth, keys dotted; arrays are leaves, values text, null stays unknown.

    Each level of objects is one pass over what is left; the depth of the deepest ends the loop. Text that is no JSON gives nothing.
    """
    json = F.try_parse_json(column)
    left = rows.select(F.col(ident).alias("file"), F.lit("").alias("key"), json.alias("value")).filter("value is not null")
    found = None
    while True:
        inner = F.try_variant_get("value", "$", "map<string,variant>")
        object_ = F.schema_of_variant("value").startswith("OBJECT")
        leaves = left.filter(~object_ & (F.col("key") != "")).select("file", "key", F.try_variant_get("value", "$", "string").alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        objects = left.filter(object_)
        if objects.isEmpty():
            return found
        deep = objects.select("file", F.col("key").alias("outer"), F.explode(inner).alias("inner", "value"))
        left = settle(deep.select("file", F.when(F.col("outer") == "", F.col("inner")).otherwise(F.concat_ws(".", "outer", "inner")).alias("key"), "value"))


#: Where a workload's pod is, by kind.
_PODS = {"Pod": ("spec",), **dict.fromkeys(("Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job"), ("spec", "template", "spec")), "CronJob": ("spec", "jobTemplate", "spec", "template", "spec")}


def _resource(doc: dict) -> dict:
    """Settings of a Kubernetes resource: a ConfigMap's data, a Secret's with their values redacted, images and literal variables of a workload's containers."""
    out: dict = {}
    kind = doc["kind"]
    if kind in ("ConfigMap", "Secret"):
        for field in ("data", "stringData")[: 1 + (kind == "Secret")]:
            data = doc.get(field)
            for k, v in data.items() if isinstance(data, dict) else ():
                if kind == "Secret" or isinstance(v, str):
                    out[k] = REDACTED if kind == "Secret" else v
        return out
    pod = doc
    for step in _PODS.get(kind, ("",)):
        pod = pod.get(step) if isinstance(pod, dict) else None
    for c in [c for f in ("containers", "initContainers") for c in ((pod or {}).get(f) or []) if isinstance(c, dict)] if isinstance(pod, dict) else ():
        if isinstance(c.get("image"), str):
            out[f"container.{c.get('name', 'container')}.image"] = c["image"]
        for e in c.get("env") or []:
            if isinstance(e, dict) and isinstance(e.get("name"), str) and isinstance(e.get("value"), str):
                out[e["name"]] = e["value"]
    return out


def _shown(value, gap: str) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, separators=(gap, ":"), ensure_ascii=False, default=str)


def _flatten(prefix: str, value, out: dict, gap: str) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _flatten(f"{prefix}.{k}" if prefix else str(k), v, out, gap)
    elif gap == "yaml" and isinstance(value, list):
        out[prefix] = f"[{', '.join(value)}]" if all(isinstance(v, str) for v in value) else f"[<{len(value)} items>]"
    else:
        out[prefix] = _shown(value, gap)


def file_keys(path: str, content: str) -> dict[str, str | None]:
    """The keys of one configuration file and their values; ``ValueError`` or ``RecursionError`` where it can't be read."""
    out: dict = {}
    ending = path.rpartition("/")[2].rpartition(".")[2].lower()
    if ending == "toml":
        _flatten("", tomllib.loads(content), out, ", ")
    elif ending == "json":
        _flatten("", json.loads(content or "{}"), out, ",")
    elif ending in ("yaml", "yml"):
        for doc in yaml.documents(content):
            if isinstance(doc, dict) and "apiVersion" in doc and isinstance(doc.get("kind"), str):
                out |= _resource(doc)
            else:
                _flatten("", doc, out, "yaml")
    else:
        for line in map(str.strip, content.splitlines()):
            name, eq, value = line.removeprefix("export ").partition("=")
            if eq and name.strip() and not line.startswith("#"):
                out[name.strip()] = value.strip().strip('"').strip("'")
    return {k: v for k, v in out.items() if k}


def config_facts(files: DataFrame) -> DataFrame:
    """:func:`config_keys`, and a row without a key for each file that can't be read, with the reason as its value."""

    def read(batches):
        for pdf in batches:
            rows: list = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, k, v) for k, v in file_keys(path, content or "").items()]
                except (ValueError, RecursionError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return files.select("path", "content").mapInPandas(read, "path string, key string, value string")


def config_keys(files: DataFrame) -> DataFrame:
    """``path, key, value`` of TOML, JSON, YAML and ``.env`` contents; keys dotted, the last value of a key wins, arrays are one value each.

    Of Kubernetes resources only what a deployment sets is taken. A file that can't be read has no keys; :func:`unread` names it. Values of keys that are named like secrets are redacted by
    :func:`..functions.text.redacted`.
    """
    return config_facts(files).filter("key is not null")


def unread(files: DataFrame) -> DataFrame:
    """``path, reason`` of the configuration files that can't be read."""
    return config_facts(files).filter("key is null").select("path", F.col("value").alias("reason"))


#: How a comment line begins.
COMMENT_STARTS = ("//", "#", "*", "/*", "<!--", ";", "--")


def annotations(files: DataFrame, tag: str = "@ref") -> DataFrame:
    """``path, id`` of ``@ref:<id>`` in comment lines, outside code spans."""
    start = "|".join(re.escape(c) for c in COMMENT_STARTS)
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("line")).filter(F.col("line").rlike(rf"(?U)^\s*(?:{start})"))
    return lines.select("path", F.explode(F.regexp_extract_all(without_code(F.col("line")), F.lit(rf"{tag}:([A-Za-z0-9_-]+)"), 1)).alias("id")).distinct()


def _outline(files: DataFrame) -> DataFrame:
    """Headings and lines with ``[[`` of Markdown contents, outside code fences: ``path, place, line, level, title, parent, within``.

    ``level`` is null for lines that are no headings; ``parent`` is the nearest shallower heading before (title and place), ``within`` the nearest heading before.
    """
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("place", "line"))
    fence, heading = F.col("line").rlike(r"(?U)^\s*```"), F.col("line").rlike("^#{1,6} ")
    marks = lines.withColumn("fence", fence).filter(F.col("fence") | heading | F.col("line").contains("[["))
    upto = Window.partitionBy("path").orderBy("place")
    open_ = F.count_if("fence").over(upto.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    found = marks.withColumn("open", open_).filter(~F.col("fence") & ~F.col("open")).select("path", "place", "line", F.when(heading, F.length(F.regexp_extract("line", "^(#+) ", 1))).alias("level"))
    found = found.withColumn("title", F.when(F.col("level").isNotNull(), F.regexp_replace(F.regexp_replace("line", "^#+ ", ""), r"(?U)^\s+|\s+\z", "")))
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("place", "title")
    last = [F.last(F.when(F.col("level") == n, own), ignorenulls=True).over(before).alias(f"l{n}") for n in range(1, 7)]
    wide = found.select("*", *last, F.last(F.when(F.col("level").isNotNull(), own), ignorenulls=True).over(before).alias("within"))
    above = [F.when(F.col("level") > n, F.col(f"l{n}")) for n in range(1, 7)]
    return wide.select("path", "place", "line", "level", "title", F.array_max(F.array(*above)).alias("parent"), "within")


def headings(files: DataFrame) -> DataFrame:
    """``path, place, level, title, slug, parent`` of Markdown headings outside code fences; the parent is the nearest shallower heading before."""
    found = _outline(files).filter("level is not null")
    return found.select("path", "place", "level", "title", slug(F.col("title")).alias("slug"), F.col("parent.title").alias("parent"))


#: The prefix of section keys and their kind.
SECTION, SECTION_KIND = "lat", "lat_section"


def _stem(name: Column) -> Column:
    """Lower-case name without directories and the last ending."""
    return F.lower(F.regexp_replace(F.substring_index(name, "/", -1), r"(?s)^(.*)\.[^.]*\z", "$1"))


def sections(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and authored edges of Markdown files (path, content) and their sections.

    A file contains its sections, a section those below it. ``[[stem]]`` and ``[[stem#Section]]`` name a file of these, the first by path of its
    stem, or its deepest section; ``[[path#Symbol]]`` and ``[[path]]`` name code. A link is that of the section around it, or of the file before the first.
    Of sections with one slug the last gives the name.
    """
    of = lambda path, title=None: F.concat(F.lit(f"{SECTION}:"), path, *([] if title is None else [F.lit("#"), slug(title)]))
    rows = settle(_outline(files))
    found = rows.filter("level is not null").select("path", "place", "title", of(F.col("path"), F.col("title")).alias("key"), F.when(F.col("parent").isNull(), of(F.col("path"))).otherwise(of(F.col("path"), F.col("parent.title"))).alias("above"))
    inner = found.groupBy("key").agg(F.max_by("title", "place").alias("name"), F.first("path").alias("path")).select("key", F.lit(SECTION_KIND).alias("kind"), "name", "path")
    first = found.groupBy("path").agg(F.min_by("title", "place").alias("title"))
    docs = files.select("path").join(first, "path", "left").select(of(F.col("path")).alias("key"), F.lit("doc").alias("kind"), F.coalesce("title", _stem(F.col("path"))).alias("name"), "path")
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    links = rows.filter("level is null").select(F.when(F.col("within").isNull(), of(F.col("path"))).otherwise(of(F.col("path"), F.col("within.title"))).alias("src"), F.explode(wiki_links(F.col("line"))).alias("raw"))
    parts = links.select("src", trimmed(F.substring_index("raw", "#", 1)).alias("head"), F.when(F.col("raw").contains("#"), trimmed(F.regexp_replace("raw", r"(?s)^[^#]*#", ""))).alias("rest"))
    plain = ~F.col("head").contains("/") & F.lower("head").rlike(r"^(?:[^.]*|.*\.md)\z")
    index = files.groupBy(_stem(F.col("path")).alias("stem")).agg(F.min("path").alias("there"))
    named = parts.withColumn("stem", F.when(plain, _stem(F.col("head")))).join(index, "stem", "left")
    ending = F.lower(F.regexp_extract("head", r"\.([^.]*)\z", 1))
    lang = F.when(~F.col("head").contains("."), "text").when(ending == "rs", "rust").otherwise(ending)
    code = F.when(F.col("head") == "", None).when(F.coalesce("rest", F.lit("")) != "", F.concat(F.lit("sym:"), lang, F.lit(":"), "head", F.lit("#"), "rest")).otherwise(F.concat(F.lit("file:"), "head"))
    inside = F.when(F.col("rest").isNull(), of(F.col("there"))).otherwise(of(F.col("there"), trimmed(F.substring_index("rest", "#", -1))))
    refs = named.select("src", F.when(F.col("there").isNotNull(), inside).otherwise(code).alias("dst"), F.lit("references").alias("kind")).filter("dst is not null")
    edges = found.select(F.col("above").alias("src"), F.col("key").alias("dst"), F.lit("contains").alias("kind")).unionByName(refs).distinct()
    return docs.unionByName(inner).withColumn("provenance", F.lit("authored")), edges.withColumn("provenance", F.lit("authored"))


def base_images(files: DataFrame) -> DataFrame:
    """External images of ``FROM`` lines; earlier stages' names are no images."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("place", "line"))
    pattern = r"(?i)^\s*FROM\s+(?:--\S+\s+)?(\S+)(?:\s+AS\s+(\S+))?"
    stages = lines.filter(F.col("line").rlike(pattern)).select("path", "place", F.regexp_extract("line", pattern, 1).alias("ref"), F.lower(F.regexp_extract("line", pattern, 2)).alias("stage"))
    earlier = F.collect_set("stage").over(Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return stages.withColumn("earlier", earlier).filter(~F.array_contains("earlier", F.lower("ref")) & (F.lower("ref") != "scratch")).select("path", "place", "ref", *image_reference(F.col("ref")))


def wav_facts(rows: DataFrame) -> DataFrame:
    """Rate, channels, depth, frames and milliseconds of WAV contents (path, content), from their headers."""

    def read(batches):
        import struct

        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                if data is None or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
                    continue
                at, fmt, size = 12, None, None
                while at + 8 <= len(data):
                    name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
                    if name == b"fmt ":
                        fmt = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
                    if name == b"data":
                        size = n
                    at += 8 + n + n % 2
                if fmt and size is not None and fmt[4] and fmt[2]:
                    frames = size // fmt[4]
                    out.append((path, fmt[2], fmt[1], fmt[5], frames, frames * 1000 // fmt[2]))
            yield pd.DataFrame(out, columns=["path", "rate", "channels", "depth", "frames", "ms"])

    return rows.select("path", "content").mapInPandas(read, "path string, rate bigint, channels bigint, depth bigint, frames bigint, ms bigint")


#: Fixed value: structs within structs that are followed.
STRUCT_DEPTH = 16


def struct_keys(fields: DataFrame) -> DataFrame:
    """``path, key, struct`` of the configuration keys that root structs declare: a field of a struct's type is followed, any other is a leaf.

    ``fields``: path, struct, root (whether it is one), field, type (null where no struct of the file). A struct that holds itself is not followed again, nor is one
    deeper than :data:`STRUCT_DEPTH`; the field is a leaf then. Of a key from several roots the first by name stays.
    """
    fields = settle(fields)  # read by every step
    held = fields.select("path", F.col("struct").alias("type"), F.col("field").alias("inner"), F.col("type").alias("next"))
    known = fields.select("path", F.col("struct").alias("type"), F.lit(True).alias("known")).distinct()
    now = fields.filter("root").select("path", F.col("struct").alias("from"), F.col("field").alias("key"), "type", F.array("struct").alias("seen"))
    found = None
    for depth in range(STRUCT_DEPTH + 1):
        go = F.coalesce(F.col("known") & ~F.array_contains("seen", F.col("type")), F.lit(False)) if depth < STRUCT_DEPTH else F.lit(False)
        told = settle(now.join(known, ["path", "type"], "left").select("path", "from", "key", "type", "seen", go.alias("go")))
        leaves = told.filter("not go").select("path", "key", "from")
        found = leaves if found is None else found.unionByName(leaves)
        deeper = told.filter("go").drop("go")
        if deeper.isEmpty():
            break
        now = deeper.join(held, ["path", "type"]).select("path", "from", F.concat_ws(".", "key", "inner").alias("key"), F.col("next").alias("type"), F.concat("seen", F.array("type")).alias("seen"))
    return found.groupBy("path", "key").agg(F.min("from").alias("struct"))


#: How a blueprint is told by its path and its first heading, and the field of a published page.
BLUEPRINT, PLAN, PAGE = "docs/blueprint", "— Technical Implementation Plan", "site-page"


def document_kinds(files: DataFrame) -> DataFrame:
    """``path, kind`` of Markdown contents: an ``adr`` (a record with an id before its title in the file's name, below ``docs/adr``), a ``blueprint``, a ``page`` that names itself in its front matter, or ``plain``."""
    front = F.regexp_extract("content", r"\A---\n([\s\S]*?)\n---(?:\n|\z)", 1)
    page = F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{PAGE}:(.*)$", 1)), F.lit("")).isNotNull()
    title = F.regexp_extract(F.regexp_replace("content", r"(?s)```.*?(?:```|\z)", ""), r"(?m)^# +(.+)$", 1)
    kind = F.when(F.col("path").rlike(r"^docs/adr/[0-9]+-[^/]*\.md\z"), "adr").when(page, "page").when(F.lower("path").startswith(BLUEPRINT) | title.contains(PLAN), "blueprint").otherwise("plain")
    return files.select("path", kind.alias("kind"))
