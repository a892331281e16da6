"""Drifting schemas: changes between the files of a feed, and one table of all records.

1. `flatten` turns each JSON payload into one row per leaf: dotted path, type
   and the value in one canonical spelling ("on" is true, "37.8%" is 0.378,
   ["en", "vi"] is en,vi), so that a value compares equal however it is written.
   The rows are kept once; canonical values serve as evidence only.
2. `file_schemas` aggregates the leaves to the schema tree of each file.
3. `edit_scripts` compares each file with the one of the next lower number by
   the constrained edit distance of unordered trees (`tree_edit`), with moves as a
   second pass. Paths that both files have are kept, with a change of type or
   none, and cut off. Deleting or adding a leaf costs 1, an object little.
   Mapping a leaf to another costs less than both only if the records bear it
   out: the same record holds equal values under both paths, and the agreement
   is more than chance, or the paths have the same words. Settings that change
   between deliveries of the same record bear nothing out. Nothing depends on
   what a field is called.
4. `projections` compiles the scripts: every path of every file to one
   canonical path; `unified` applies them to all records and keeps every value
   as it is.

The values that serve as evidence stay distributed: they are counted by pair
of paths and pair of values before they meet how frequent a value is, so that a
setting with one value for all records is one row. What one task holds is
bounded by the width of a schema, never by rows.

Defined results: a NULL, broken or non-object payload contributes nothing; a
field that is NULL in all records of a file isn't in that file; a field with
several types in one file has its most frequent type, the alphabetically first
of ties; repeated rows count once; the first file of a feed has no changes;
empty tables give empty results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.nested import parsed
from foliospark.operators.tree_edit import Distance, Node, moves, tree
from foliospark.session import saved

LEAF = "feed string, file_seq int, document_id string, path string, kind string, value string"
SCRIPT = "feed string, file_seq int, change_kind string, field_path string, new_path string"
OBJECT = 0.05  # cost of adding or deleting an object, which holds no value
APART = 2.0  # cost of deleting one leaf and adding another
BLOCK = 1024  # file numbers that are ordered in one task
MIN_BITS = 3.0  # agreement of values counts as more than chance from so many bits
MAX_DISAGREE = 0.1

_TRUE, _FALSE = {"true", "on", "yes"}, {"false", "off", "no"}
_NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


def canonical(value: object) -> str:
    """One spelling of a value, whatever its type."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return format(round(float(value), 6), ".9g")
    if isinstance(value, list):
        return ",".join(canonical(x) for x in value)
    text = str(value).strip()
    low = text.lower()
    if low in _TRUE or low in _FALSE:
        return "true" if low in _TRUE else "false"
    if low.endswith("%") and _NUMBER.fullmatch(low[:-1].strip()):
        return canonical(float(low[:-1]) / 100)
    if _NUMBER.fullmatch(text):
        return canonical(float(text))
    return ",".join(canonical(x) if x else "" for x in text.split(",")) if "," in text else text


def kind_of(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, (int, float)) else "array" if isinstance(value, list) else "string"


def leaves(node: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(dotted path, value) of every value that is no object and not NULL."""
    for key, value in node.items():
        if isinstance(value, dict):
            yield from leaves(value, f"{prefix}{key}.")
        elif value is not None:
            yield prefix + key, value


def flatten(df: DataFrame) -> DataFrame:
    """One row per leaf; df has feed, file_seq and payload, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for feed, seq, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (doc := parsed(text)) is not None:
                    rid = doc.get("document_id")
                    rid = rid if rid is None else str(rid)
                    out += [(feed, seq, rid, path, kind_of(v), canonical(v)) for path, v in leaves(doc)]
            cols = list(zip(*out)) or [()] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["feed", "file_seq", "document_id", "path", "kind", "value"])

    return df.select("feed", F.col("file_seq").cast("int"), "payload").mapInArrow(run, LEAF)


def file_schemas(flat: DataFrame) -> DataFrame:
    """feed, file_seq, path, kind: the schema of each file."""
    counts = flat.groupBy("feed", "file_seq", "path", "kind").count()
    first = F.min(F.struct((-F.col("count")).alias("n"), "kind"))
    return counts.groupBy("feed", "file_seq", "path").agg(first.alias("_m")).select("feed", "file_seq", "path", F.col("_m.kind").alias("kind"))


def predecessors(files: DataFrame) -> DataFrame:
    """feed, file_seq, before: the next lower number of each file's feed, where there is one.

    Numbers are ordered in blocks, and the last one of each block over the
    blocks, so that a feed of any length comes into no single task.
    """
    f = files.select("feed", "file_seq").distinct().withColumn("block", F.floor(F.col("file_seq") / BLOCK))
    ends = f.groupBy("feed", "block").agg(F.max("file_seq").alias("end"))
    ends = ends.withColumn("end_before", F.lag("end").over(Window.partitionBy("feed").orderBy("block"))).drop("end")
    inside = F.lag("file_seq").over(Window.partitionBy("feed", "block").orderBy("file_seq"))
    f = f.withColumn("inside", inside).join(ends, ["feed", "block"])
    return f.select("feed", "file_seq", F.coalesce("inside", "end_before").alias("before")).where("before is not null")


def _edges(schemas: DataFrame) -> DataFrame:
    """Per file with a predecessor: arrays of kept, removed, added and retyped leaves."""
    trees = schemas.groupBy("feed", "file_seq").agg(F.map_from_entries(F.collect_list(F.struct("path", "kind"))).alias("now"))
    old = trees.select("feed", F.col("file_seq").alias("before"), F.col("now").alias("old"))
    pair = trees.join(predecessors(schemas), ["feed", "file_seq"]).join(old, ["feed", "before"])
    return pair.select(
        "feed",
        "file_seq",
        F.array_intersect(F.map_keys("old"), F.map_keys("now")).alias("kept"),
        F.array_sort(F.array_except(F.map_keys("old"), F.map_keys("now"))).alias("removed"),
        F.array_sort(F.array_except(F.map_keys("now"), F.map_keys("old"))).alias("added"),
        F.array_sort(F.filter(F.map_keys("now"), lambda p: F.col("old")[p].isNotNull() & (F.col("old")[p] != F.col("now")[p]))).alias("retyped"),
    )


def _evidence(flat: DataFrame, edges: DataFrame) -> DataFrame:
    """Per feed and pair (removed path, added path): records that agree and disagree, and bits of agreement."""
    both = edges.where((F.size("removed") > 0) & (F.size("added") > 0))
    role = both.select("feed", F.explode(F.concat(F.transform("removed", lambda p: F.struct(p.alias("path"), F.lit(1).alias("old"))), F.transform("added", lambda p: F.struct(p.alias("path"), F.lit(0).alias("old"))))).alias("r"))
    role = role.groupBy("feed", "r.path").agg((F.max("r.old") == 1).alias("is_old"), (F.min("r.old") == 0).alias("is_new"))
    values = flat.where(F.col("document_id").isNotNull()).groupBy("feed", "document_id", "path").agg(F.min("value").alias("value"), (F.min("value") != F.max("value")).alias("varies")).join(role, ["feed", "path"])
    # what differs between deliveries of the same record says nothing about where a setting goes
    steady = values.groupBy("feed", "path").agg(F.avg(F.col("varies").cast("int")).alias("v")).where(F.col("v") <= MAX_DISAGREE)
    values = values.join(steady, ["feed", "path"], "left_semi").drop("varies")
    # a record has at most one value of each path, so both sides are bounded by the schema
    per = values.groupBy("feed", "document_id").agg(F.collect_list(F.when(F.col("is_old"), F.struct("path", "value"))).alias("olds"), F.collect_list(F.when(F.col("is_new"), F.struct("path", "value"))).alias("news"))
    pairs = per.select("feed", F.explode("olds").alias("o"), "news").select("feed", "o", F.explode("news").alias("n")).where("o.path <> n.path")
    # counted before values meet their frequency: a constant setting is one row here
    pairs = pairs.groupBy("feed", F.col("o.path").alias("old"), F.col("n.path").alias("new"), F.when(F.col("o.value") == F.col("n.value"), F.col("o.value")).alias("value")).agg(F.count("*").alias("n"))
    # how surprising a value is: the share of the feed's records that have it under this path
    rate = values.groupBy("feed", "path", "value").agg(F.count("*").alias("n"))
    total = rate.groupBy("feed", "path").agg(F.sum("n").alias("t"))
    bits = rate.join(total, ["feed", "path"]).select("feed", "path", "value", F.log2(F.col("t") / F.col("n")).alias("bits"))
    side = lambda c: bits.withColumnRenamed("path", c).withColumnRenamed("bits", "bits_" + c)
    pairs = pairs.join(side("old"), ["feed", "old", "value"], "left").join(side("new"), ["feed", "new", "value"], "left")
    same = F.col("value").isNotNull()
    number = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return pairs.groupBy("feed", "old", "new").agg(number(same).alias("agree"), number(~same).alias("differ"), F.sum(F.when(same, F.col("n") * F.least("bits_old", "bits_new")).otherwise(0.0)).alias("bits"))


def words(path: str, shared: set[str]) -> list[str]:
    """The words of a path below the objects that both schemas have."""
    parts = path.split(".")
    top = max((n for n in range(len(parts)) if ".".join(parts[:n]) in shared), default=0)
    return [w for w in re.split(r"[._]", ".".join(parts[top:]).lower()) if w]


def likeness(a: list[str], b: list[str]) -> float:
    """Shared words of two paths over all their words, in 0..1."""
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def rename_cost(like: float, ev: tuple[int, int, float] | None) -> float:
    """Cost of mapping one leaf to another; APART or more means delete and add instead."""
    agree, differ, bits = ev or (0, 0, 0.0)
    if agree + differ == 0:
        return 0.1 if like == 1.0 else APART
    if differ > MAX_DISAGREE * (agree + differ) or (bits < MIN_BITS and like < 0.3):
        return APART
    return 0.1 + 1.0 / (1.0 + bits) + 0.5 * (1 - like)


def objects(paths: list[str]) -> set[str]:
    """The objects that hold some of the paths, at any depth."""
    return {".".join(parts[:n]) for p in paths for parts in [p.split(".")] for n in range(len(parts))}


def script(kept: list[str], removed: list[str], added: list[str], retyped: list[str], evidence: dict[tuple[str, str], tuple[int, int, float]]) -> list[tuple[str, str, str]]:
    """The minimum-cost edit script of one file: (change_kind, field_path, new_path)."""
    out = [("retyped", p, "") for p in retyped]
    gone, come = set(removed), set(added)
    if removed and added:
        before, now = objects([*kept, *removed]), objects([*kept, *added])
        shared = before & now
        spelt = {p: words(p, shared) for p in (*removed, *added)}
        leaf = lambda o, n: rename_cost(likeness(spelt[o], spelt[n]), evidence.get((o, n)))

        def change(a: Node, b: Node) -> float:
            if a.leaf != b.leaf:
                return 2 * APART
            if a.leaf:
                return min(APART, leaf(a.path, b.path))
            if a.path == b.path:
                return 0.0
            # an object that goes on under its name cannot become another
            return 2 * APART if a.path in shared or b.path in shared else 1.5 * OBJECT

        _, pairs = Distance(change, lambda n: 1.0 if n.leaf else OBJECT).trees(tree(removed), tree(added))
        renamed = [(a.path, b.path) for a, b in pairs if a.leaf and b.leaf and leaf(a.path, b.path) < APART]
        gone -= {o for o, _ in renamed}
        come -= {n for _, n in renamed}
        renamed += moves(sorted(gone), sorted(come), leaf, APART)
        gone -= {o for o, _ in renamed}
        come -= {n for _, n in renamed}
        out += [("renamed", o, n) for o, n in sorted(renamed)]
    return out + [("removed", p, "") for p in sorted(gone)] + [("added", p, "") for p in sorted(come)]


def edit_scripts(df: DataFrame, flat: DataFrame | None = None) -> DataFrame:
    """One row per change of a file against its predecessor in the feed; the flattened leaves may be given."""
    flat = saved(flatten(df), "leaves") if flat is None else flat
    edges = saved(_edges(file_schemas(flat)), "schema-edges")
    ev = _evidence(flat, edges)
    cand = edges.select("feed", "file_seq", F.explode("removed").alias("old"), "added").select("feed", "file_seq", "old", F.explode("added").alias("new"))
    facts = cand.join(ev, ["feed", "old", "new"]).groupBy("feed", "file_seq").agg(F.collect_list(F.struct("old", "new", "agree", "differ", "bits")).alias("facts"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                known = {(f["old"], f["new"]): (f["agree"], f["differ"], f["bits"]) for f in (r.facts if r.facts is not None else [])}
                out += [(r.feed, r.file_seq, *change) for change in script(list(r.kept), list(r.removed), list(r.added), list(r.retyped), known)]
            yield pd.DataFrame(out, columns=["feed", "file_seq", "change_kind", "field_path", "new_path"])

    return edges.join(facts, ["feed", "file_seq"], "left").mapInPandas(solve, SCRIPT)


def projections(changes: DataFrame, schemas: DataFrame, max_fields: int = 10_000) -> tuple[dict[str, str], dict[str, str]]:
    """Compile the scripts: each path's canonical path, and each canonical path's type.

    Paths joined by renames, in any feed, are one setting; it goes by the path
    most files use (the alphabetically first of ties). Its type is the one most
    files use. Only distinct paths and renames come to the driver: their number
    is the width of the schemas, checked against max_fields.
    """
    use = schemas.groupBy("path", "kind").agg(F.count("*").alias("n")).limit(max_fields + 1).collect()
    moves = changes.where("change_kind = 'renamed'").select("field_path", "new_path").distinct().limit(max_fields + 1).collect()
    if max(len(use), len(moves)) > max_fields:
        raise ValueError(f"more than {max_fields} distinct paths: these records have no schema to unify")
    root: dict[str, str] = {}

    def find(p: str) -> str:
        while root.get(p, p) != p:
            p = root[p]
        return p

    for a, b in moves:
        root[find(a)] = find(b)
    groups: dict[str, dict[str, int]] = {}
    kinds: dict[str, dict[str, int]] = {}
    for path, kind, n in use:
        groups.setdefault(find(path), {}).setdefault(path, 0)
        groups[find(path)][path] += n
        kinds.setdefault(find(path), {}).setdefault(kind, 0)
        kinds[find(path)][kind] += n
    best = lambda d: min(d, key=lambda k: (-d[k], k))
    name = {g: best(paths) for g, paths in groups.items()}
    return {p: name[g] for g, paths in groups.items() for p in paths}, {name[g]: best(k) for g, k in kinds.items()}


def written(value: object) -> str:
    """A value as it stands: text itself, anything else as JSON."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def converted(value: object, kind: str) -> object:
    """The value in a column's type, or None where the type cannot hold it exactly."""
    if kind == "string":
        return written(value)
    if kind == "boolean":
        low = str(value).strip().lower()
        return value if isinstance(value, bool) else True if isinstance(value, str) and low in _TRUE else False if isinstance(value, str) and low in _FALSE else None
    if kind == "array":
        items = value if isinstance(value, list) else value.split(",") if isinstance(value, str) else [value]
        return [x.strip() if isinstance(x, str) else None if x is None else written(x) for x in items]
    if isinstance(value, (bool, list)):
        return None
    if isinstance(value, str):
        text = value.strip()
        share = text.endswith("%")
        text = text[:-1].strip() if share else text
        if not _NUMBER.fullmatch(text):
            return None
        number = float(f"{text}e-2") if share and "e" not in text.lower() else float(text) / (100 if share else 1)
        return number if share or not text.lstrip("+-").isdigit() or int(number) == int(text) else None
    return float(value) if isinstance(value, float) or int(float(value)) == value else None


def unified(df: DataFrame, paths: dict[str, str], kinds: dict[str, str]) -> DataFrame:
    """All records in one table: keys, then one column per setting in its canonical type.

    Columns are named by the canonical path with dots as two underscores; numbers
    are DOUBLE, booleans BOOLEAN, arrays ARRAY<STRING>, strings as they stand. A
    value that its column's type cannot hold exactly stands in `unconverted`, a
    map of paths to values as written. Distinct rows.
    """
    names = sorted(kinds)
    column = {c: c.replace(".", "__") for c in names}
    sql = {"number": "double", "boolean": "boolean", "array": "array<string>"}
    arrow = {"number": pa.float64(), "boolean": pa.bool_(), "array": pa.list_(pa.string())}
    fields = [("feed", pa.string()), ("file_seq", pa.int32()), *((column[c], arrow.get(kinds[c], pa.string())) for c in names), ("unconverted", pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])))]
    schema = ", ".join(["feed string", "file_seq int", *(f"`{column[c]}` {sql.get(kinds[c], 'string')}" for c in names), "unconverted array<struct<path:string,value:string>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {n: [] for n, _ in fields}
            for feed, seq, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (doc := parsed(text)) is None:
                    continue
                row, rest = {}, []
                for path, v in leaves(doc):
                    name = paths.get(path)
                    if name is None:
                        continue
                    got = converted(v, kinds[name])
                    if got is None or column[name] in row:
                        rest.append({"path": path, "value": written(v)})
                    else:
                        row[column[name]] = got
                row |= {"feed": feed, "file_seq": seq, "unconverted": sorted(rest, key=lambda r: (r["path"], r["value"]))}
                for n in cols:
                    cols[n].append(row.get(n))
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in fields], names=[n for n, _ in fields])

    return df.select("feed", F.col("file_seq").cast("int"), "payload").mapInArrow(run, schema).distinct().withColumn("unconverted", F.map_from_entries("unconverted"))
