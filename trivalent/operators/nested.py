"""Problem 2: deeply nested records to related flat tables, by single-pass tagged emission.

A depth-first visitor goes through each record once and emits, for every object or list that is a
table of its own, (tag, record, key, parent key, analysis, place, payload). Keys count the emissions
of a record, so that no two rows of it share one, whatever places a writer names; the named place is a
column. The rows are written partitioned by tag, and each tag's schema is applied when its part is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from ..session import scratch_path

ANALYSES = ("all_edge_pairs", "three_edge_paths")
EMITTED = "tag string, record_id long, line_no long, text_hash long, line_uid long, pk int, parent_pk int, analysis string, place int, payload string"
_GRAPH = {"canonical_graph_hash": "hash", "edge_count": "int", "face_size_multiset": "ints"}
#: The members of each object, as its writers name them, with the type each is read as.
MEMBERS = {
    "record": {
        "generation_index": "long", "requested_vertex_count": "int", **_GRAPH,
        "plantri_version": "string", "plantri_executable_sha256": "string", "plantri_command": "strings",
    },
    "analysis": {
        "graph_order": "int", **_GRAPH, "number_of_constrained_sat_calls": "int", "number_of_witness_cycles": "int", "witness_cover_ratio": "double",
        "total_sat_wall_time_seconds": "double", "median_query_time_seconds": "double", "p95_query_time_seconds": "double",
        "p99_query_time_seconds": "double", "maximum_query_time_seconds": "double", "total_subtour_iterations": "int",
        "total_subtour_constraints": "int", "property_satisfied": "boolean", "candidate_requires_review": "boolean", "candidate_report_path": "string",
        "backtracking_queries": "int", "backtracking_agreements": "int", "backtracking_runtime_seconds": "double", "total_ordered_edge_pairs": "int",
        "average_pairs_certified_per_witness": "double", "maximum_pairs_certified_by_one_witness": "int", "number_of_distinct_three_edge_paths": "int",
        "average_paths_certified_per_witness": "double", "maximum_paths_certified_by_one_witness": "int",
    },
    "witness": {"trigger_key": "json", "certificate_hash": "hash", "newly_certified_constraints": "int"},
}
#: Members that are rows of other tables, not payload.
CHILDREN = {"record": ANALYSES, "analysis": ("hardest_ordered_pair", "hardest_path", "witnesses"), "witness": ("cycle",)}
_TYPES = {"ints": "array<int>", "strings": "array<string>", "hash": "string", "json": "string"}
#: Numbers of a list, and their places where they aren't simply 0, 1, 2 and so on.
_LIST = "struct<v:array<int>,at:array<int>>"
#: Schema of each tag's payload; ``others`` holds all further members as JSON, so none is lost.
PAYLOADS = {tag: "struct<" + ",".join(f"{k}:{_TYPES.get(t, t)}" for k, t in m.items()) + ",others:map<string,string>>" for tag, m in MEMBERS.items()} | {
    "hardest_edge": _LIST, "hardest_path": _LIST, "cycle": _LIST,
}
_NUMBER = re.compile(r"\d+")
_INDEX = ("witness_index", "index", "place", "position")
_WITNESS = ("cycle", "newly_certified_constraints", "trigger_key", "certificate_hash")
_MARKS = " \t\r\n\x00\x1e\ufeff\u200b\u00a0"
CHUNK = 20_000  # rows a task holds before it passes them on
Numbers = list[tuple[int, int]]


def loaded(text: str) -> Any:
    """The value of a JSON text; one nested too deep for the parser is no JSON here."""
    try:
        return json.loads(text)
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def value_of(x: Any) -> Any:
    """An object or list written as text is read as what it holds."""
    while isinstance(x, str):
        s = x.strip(_MARKS)
        if s[:1] not in ("{", "["):
            return x
        try:
            x = loaded(s)
        except ValueError:
            return x
    return x


def number_of(x: Any, bits: int = 31) -> int | None:
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, int):
        return x if abs(x) < 2**bits else None
    if isinstance(x, float):
        return int(x) if x == x and abs(x) < 2**bits and x == int(x) else None
    if isinstance(x, str):
        try:
            return number_of(int(x) if x.strip().lstrip("+-").isdigit() else float(x), bits)
        except ValueError:
            return None
    return None


def _real(x: Any) -> float | None:
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        return None
    try:
        return float(x)
    except (ValueError, OverflowError):
        return None


def _typed(x: Any, kind: str) -> Any:
    """A member's value as the type it is read as; null where it is none of that type."""
    if kind == "int" or kind == "long":
        return number_of(x, 31 if kind == "int" else 63)
    if kind == "double":
        r = _real(x)
        return r if r is not None and abs(r) < float("inf") else None
    if kind == "boolean":
        return x if isinstance(x, bool) else {"true": True, "false": False}.get(x.strip().lower()) if isinstance(x, str) else None
    if kind == "ints":
        return [n for _, n in numbers_of(x)] if value_of(x) is not None else None
    if kind == "strings":
        v = value_of(x)
        return [s if isinstance(s, str) else json.dumps(s) for s in v] if isinstance(v, list) else None if v is None else [v if isinstance(v, str) else json.dumps(v)]
    if x is None:
        return None
    if kind == "json":
        return json.dumps(value_of(x), separators=(",", ":"), sort_keys=True)
    s = x if isinstance(x, str) else json.dumps(x)
    return s.strip().lower() if kind == "hash" else s


def _payload(tag: str, x: dict, around: Iterable[tuple[str, Any]] = ()) -> dict:
    known = MEMBERS[tag]
    out = {k: v for k, t in known.items() if k in x and (v := _typed(x[k], t)) is not None}
    more = [*around, *((k, v) for k, v in x.items() if k not in known and k not in CHILDREN[tag])]
    if more:
        out["others"] = {str(k): json.dumps(v, separators=(",", ":"), sort_keys=True) for k, v in more}
    return out


def _wrapped(x: dict) -> Any:
    """What a wrapper holds: its one list or object beside scalars."""
    inner = [v for v in map(value_of, x.values()) if isinstance(v, (list, dict))]
    return inner[0] if len(inner) == 1 else None


def _placed(x: dict) -> bool:
    return bool(x) and all(_NUMBER.fullmatch(k.strip()) and len(k) < 10 for k in x)


def _inside(x: Any, known: Any) -> Any:
    """What lies inside wrappers: goes in until ``known`` says so of an object, or it is none."""
    x = value_of(x)
    while isinstance(x, dict) and not known(x):
        x = _wrapped(x)
    return x


def numbers_of(x: Any) -> Numbers:
    """(place, number) of a list, a text of numbers, or a wrapper around either.

    An object with u and v, or with numbered members, has the places it names. What is no number
    is left out and keeps its place, so that the others keep theirs.
    """
    x = _inside(x, lambda d: "u" in d or "v" in d or _placed(d))
    if isinstance(x, dict):
        pairs = [(0, x.get("u")), (1, x.get("v"))] if "u" in x or "v" in x else sorted(((int(k), v) for k, v in x.items()), key=lambda p: p[0])
    elif isinstance(x, str):
        pairs = list(enumerate(_NUMBER.findall(x)))
    else:
        pairs = list(enumerate(x)) if isinstance(x, list) else [(0, x)]
    return [(p, n) for p, v in pairs if (n := number_of(v)) is not None]


def edges_of(x: Any) -> list[tuple[int, Numbers]]:
    """(role, endpoints) of an ordered pair of edges; role 0 is required, 1 forbidden."""
    x = _inside(x, lambda d: "required" in d or "forbidden" in d or _placed(d))
    if isinstance(x, dict):
        pairs = [(0, x.get("required")), (1, x.get("forbidden"))] if "required" in x or "forbidden" in x else sorted(((int(k), v) for k, v in x.items()), key=lambda p: p[0])
    else:
        pairs = list(enumerate(x)) if isinstance(x, list) else []
    return [(i, e) for i, v in pairs if (e := numbers_of(v))]


def cycle_of(x: Any) -> Numbers:
    c = numbers_of(x)
    return c[:-1] if len(c) > 1 and c[0][1] == c[-1][1] else c


def witnesses_of(x: Any) -> list[tuple[int, dict]]:
    """(place, witness) of a list, of an object by places, or of a lone witness; each listing is one, also under a place given before."""
    x = _inside(x, lambda d: _placed(d) or any(k in d for k in _WITNESS))
    if isinstance(x, dict):
        pairs = [(int(k), v) for k, v in x.items()] if _placed(x) else [(0, x)]
    else:
        pairs = list(enumerate(x)) if isinstance(x, list) else []
    out = []
    for place, w in pairs:
        w = value_of(w)
        while isinstance(w, list) and len(w) == 1:
            w = value_of(w[0])
        if isinstance(w, dict) and w:
            named = next((n for k in _INDEX if (n := number_of(w.get(k))) is not None), None)
            out.append((place if named is None else named, w))
    return sorted(out, key=lambda p: p[0])


def record_of(text: str | None) -> tuple[dict, list[tuple[str, Any]]] | None:
    """The census record in a line, a complete JSON object, and the scalars of the wrappers around it."""
    if text is None:
        return None
    try:
        x = value_of(loaded(text.strip(_MARKS)))
    except ValueError:
        return None
    if not isinstance(x, dict):
        return None
    around: list[tuple[str, Any]] = []
    while not (any(a in x for a in ANALYSES) or "canonical_graph_hash" in x):
        inner = value_of(x.get("record")) if "record" in x else _wrapped(x)
        while isinstance(inner, list) and len(inner) == 1:
            inner = value_of(inner[0])
        if not isinstance(inner, dict):
            break
        around += [(k, v) for k, v in x.items() if not isinstance(value_of(v), (list, dict))]
        x = inner
    return x, around


def _analysis_of(x: Any) -> dict | None:
    known = (*CHILDREN["analysis"], *MEMBERS["analysis"])
    x = value_of(x)
    while isinstance(x, (list, dict)) and x:
        if isinstance(x, list):
            if len(x) != 1:
                return None
            x = value_of(x[0])
        elif any(k in x for k in known) or (inner := _wrapped(x)) is None:
            return x
        else:
            x = inner
    return None


def _list_payload(numbers: Numbers) -> dict:
    at = [p for p, _ in numbers]
    return {"v": [n for _, n in numbers]} | ({} if at == list(range(len(at))) else {"at": at})


def visit(record: dict, around: Iterable[tuple[str, Any]] = ()) -> Iterator[tuple[str, int, int | None, str | None, int, Any]]:
    """Depth first: (tag, key, parent key, analysis, place, payload); keys count up from 0."""
    yield "record", 0, None, None, 0, _payload("record", record, around)
    key = 0
    for name in ANALYSES:
        a = _analysis_of(record.get(name))
        if a is None:
            continue
        key += 1
        own = key
        yield "analysis", own, 0, name, 0, _payload("analysis", a)
        for role, e in edges_of(a.get("hardest_ordered_pair")):
            key += 1
            yield "hardest_edge", key, own, name, role, _list_payload(e)
        if path := numbers_of(a.get("hardest_path")):
            key += 1
            yield "hardest_path", key, own, name, 0, _list_payload(path)
        given = set()
        for place, w in witnesses_of(a.get("witnesses")):
            whole = (place, json.dumps(w, sort_keys=True))
            if whole in given:  # the same witness under the same named place: given twice
                continue
            given.add(whole)
            key += 1
            parent = key
            yield "witness", parent, own, name, place, _payload("witness", w)
            if c := cycle_of(w.get("cycle")):
                key += 1
                yield "cycle", key, parent, name, place, _list_payload(c)


def _slim(lines: DataFrame, record_id: str, line_no: str, text: str) -> DataFrame:
    slim = lines.select(F.col(record_id).cast("long").alias("r"), F.coalesce(F.col(line_no).cast("long"), F.lit(-(2**62))).alias("l"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("s"))
    return slim.where("r is not null and s is not null")


def emit_records(lines: DataFrame, record_id: str = "record_id", line_no: str = "line_no", text: str = "record_json", tags: Iterable[str] | None = None) -> DataFrame:
    """The tagged rows (columns: ``EMITTED``) of every line that holds a complete JSON object; of ``tags`` and ``record`` only, if given."""
    cols = [c.split()[0] for c in EMITTED.split(", ")]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
    wanted = set(PAYLOADS) if tags is None else {"record", *tags}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, out = TaskContext.get().partitionId() << 40, []
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=cols)
        for b in batches:
            for rid, no, h, s in zip(*[b.column(i).to_pylist() for i in range(4)]):
                found = record_of(s)
                if found is None:
                    continue
                uid += 1
                try:
                    out += [(tag, rid, no, h, uid, *place, json.dumps(p, separators=(",", ":"))) for tag, *place, p in visit(*found) if tag in wanted]
                except RecursionError:  # deeper than objects can be written again: as good as broken
                    continue
                if len(out) >= CHUNK:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return _slim(lines, record_id, line_no, text).mapInArrow(run, EMITTED)


def shred(lines: DataFrame, record_id: str = "record_id", line_no: str = "line_no", text: str = "record_json", tags: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Flat tables by tag, each (record_id, pk, parent_pk, analysis, place, payload in its schema); only ``tags``, if given.

    ``parent_pk`` is the ``pk`` of the row above within the same record: record 0, its analyses, their
    hardest edges, paths and witnesses, a witness's cycle. Of a record's lines the one with the largest
    number that holds a complete JSON object counts; of different texts under one number the one of the
    larger hash, and a line given twice counts once; a null number is the least. Lines without a record
    id, and null, blank or broken texts, give nothing. Byte order marks and blanks around the object are
    passed over, wrappers to any depth the parser reads. Witnesses of one place are rows of their own unless
    they are the same in full. Absent, null and empty children give no rows. Members beyond the
    schema are kept as JSON in ``others``. Extra columns are ignored.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "shredded")
    emit_records(lines, record_id, line_no, text, tags).write.partitionBy("tag").parquet(path)
    tagged = spark.read.schema(EMITTED).parquet(path)
    key = ["record_id", "line_no", "text_hash", "line_uid"]
    latest = tagged.where("tag = 'record'").groupBy("record_id").agg(F.max(F.struct(*key[1:])).alias("at")).select("record_id", "at.*")
    out = {}
    for tag in PAYLOADS if tags is None else dict.fromkeys(tags):
        # joined on the whole line key: a record of very many lines is spread over the tasks
        own = tagged.where(F.col("tag") == tag).join(latest, key, "left_semi")
        out[tag] = own.select("record_id", "pk", "parent_pk", "analysis", "place", F.from_json("payload", PAYLOADS[tag]).alias("payload"))
    return out


def of_cycles(lines: DataFrame, work: Callable[[dict[str, list[list[int]]]], list[tuple]], columns: str, record_id: str = "record_id", line_no: str = "line_no", text: str = "record_json") -> DataFrame:
    """(record_id, *columns): the rows that ``work`` makes of a record's witness cycles, given as lists by analysis.

    Lines count as for ``shred``. A record lies in its line whole, so ``work`` is done as the line is read; no table of
    cycles is written, and each line's rows alone are shuffled, to find the line that counts. For few rows a record.
    """
    row = StructType.fromDDL(columns)
    names, kind = row.names, to_arrow_type(ArrayType(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for rid, no, h, s in zip(*[b.column(i).to_pylist() for i in range(4)]):
                found = record_of(s)
                if found is None:
                    continue
                uid += 1
                cycles: dict[str, list[list[int]]] = {}
                try:
                    for tag, _, _, analysis, _, payload in visit(*found):
                        if tag == "cycle":
                            cycles.setdefault(analysis, []).append(payload["v"])
                except RecursionError:  # as good as broken, as in emit_records
                    continue
                # a line without cycles has a row too, as it may be the one that counts
                for own, x in zip(out, (rid, no, h, uid, [dict(zip(names, r)) for r in work(cycles)])):
                    own.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], kind)], names=["record_id", "line_no", "text_hash", "line_uid", "found"])

    each = _slim(lines, record_id, line_no, text).mapInArrow(run, f"record_id long, line_no long, text_hash long, line_uid long, found array<struct<{columns}>>")
    latest = each.groupBy("record_id").agg(F.max(F.struct("line_no", "text_hash", "line_uid", "found")).alias("at"))
    return latest.select("record_id", F.inline("at.found"))


def hardest_and_witness_rows(lines: DataFrame) -> DataFrame:
    """The children of both analyses as one long table: (record_id, analysis, child_name, outer_pos, inner_pos, leaf_value)."""
    t = shred(lines, tags=["hardest_edge", "hardest_path", "witness", "cycle"])

    def unrolled(tag: str, child: str) -> DataFrame:
        each = t[tag].select("record_id", "analysis", "place", F.col("payload.at").alias("at"), F.posexplode("payload.v").alias("k", "leaf_value"))
        return each.select("record_id", "analysis", F.lit(child).alias("child_name"), F.col("place").alias("outer_pos"), F.coalesce(F.get("at", F.col("k")), F.col("k")).alias("inner_pos"), "leaf_value")

    counted = t["witness"].select(
        "record_id", "analysis", F.lit("witness").alias("child_name"), F.col("place").alias("outer_pos"), F.lit(-1).alias("inner_pos"),
        F.coalesce("payload.newly_certified_constraints", F.lit(-1)).alias("leaf_value"),
    )
    return unrolled("hardest_edge", "hardest_ordered_pair").unionByName(unrolled("hardest_path", "hardest_path")).unionByName(counted).unionByName(unrolled("cycle", "cycle"))
