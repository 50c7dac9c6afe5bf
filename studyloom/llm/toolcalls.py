"""Tool calls of conversations: linked to their results, put into topological order, validated and written as canonical JSON.

Calls and results meet in a join on (conversation, identifier). A call may use another call's result by an object
``{"$ref": "<identifier>"}`` anywhere in its arguments; it must then come after that call. The order follows the positions of
the calls; a call that refers to a later one is moved behind it, and calls that wait for a moved one behind that, round by
round until nothing moves (wave by wave, as in Kahn's algorithm). Rounds follow the longest chain of moved calls, and no
conversation is gathered in one place. Where calls wait for each other in a circle, the references of one or more of them are
set aside and those calls are marked; the others come after what they use.
"""
import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.llm.tables import Scratch

REF = "$ref"


def canonical(v):
    """Canonical JSON of a parsed value: no white space, keys by UTF-16 code units, numbers as ECMAScript writes doubles."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, (bool, str)) or v is None:
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, int) and abs(v) < 1 << 53:
        return str(v)
    v = float(v)
    if v in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    if v == int(v) and abs(v) < 1e21:
        return str(int(v))
    if 1e-6 <= abs(v) < 1e-4:
        return format(Decimal(repr(v)), "f")
    return repr(v).replace("e-0", "e-").replace("e+0", "e+")


def _pairs(items):
    keys = [k for k, _ in items]
    if len(set(keys)) < len(keys):
        raise ValueError("repeated key")
    return dict(items)


def _constant(name):
    raise ValueError(f"{name} is not JSON")


def parse(text):
    """Strict JSON: no repeated keys, NaN, infinities or lone surrogates."""
    v = json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant)
    canonical(v).encode()
    return v


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool}


def _is(v, kind):
    if kind == "null":
        return v is None
    if kind in ("number", "integer"):
        return isinstance(v, (int, float)) and not isinstance(v, bool) and (kind == "number" or float(v).is_integer())
    return isinstance(v, _KINDS[kind])


def errors(v, schema, at="$"):
    """What a value violates of a schema (type, enum, required, properties, additionalProperties, items and bounds), by path.

    A reference to another call fits any schema: its value is not known before the call.
    """
    if isinstance(v, dict) and set(v) == {REF}:
        return []
    kinds = schema.get("type")
    if kinds and not any(_is(v, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    out = [f"{at}: enum"] if "enum" in schema and v not in schema["enum"] else []
    if isinstance(v, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in v]
        for k in sorted(v):
            if k in known:
                out += errors(v[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            out += errors(x, schema.get("items", {}), f"{at}[{i}]")
    size = len(v) if isinstance(v, (str, list)) else v if _is(v, "number") else None
    low, high = ("minLength", "maxLength") if isinstance(v, str) else ("minItems", "maxItems") if isinstance(v, list) else ("minimum", "maximum")
    if size is not None:
        out += [f"{at}: {k}" for k, bad in ((low, size < schema.get(low, size)), (high, size > schema.get(high, size))) if bad]
    return out


def references(v):
    if isinstance(v, dict):
        return [v[REF]] if set(v) == {REF} and isinstance(v[REF], str) else [r for x in v.values() for r in references(x)]
    return [r for x in v for r in references(x)] if isinstance(v, list) else []


def _checked(schemas):
    def check(frames):
        for pdf in frames:
            rows = []
            for name, text in zip(pdf["name"], pdf["arguments"]):
                try:
                    v = parse(text or "")
                    wrong = errors(v, schemas[name]) if name in schemas else ["$: no such tool"]
                    rows.append((canonical(v), "; ".join(wrong), sorted(set(references(v)))))
                except (ValueError, RecursionError) as e:
                    rows.append((None, f"$: not JSON ({type(e).__name__})", []))
            yield pdf[["conv_id", "call_id", "pos", "name"]].assign(
                head=[f'{{"arguments":{r[0] or "null"},"id":{canonical(i)},"name":{canonical(n)},' for r, i, n in zip(rows, pdf["call_id"], pdf["name"])],
                errors=[r[1] for r in rows], refs=[r[2] for r in rows])
    return check


def _quoted(frames):
    for pdf in frames:
        yield pdf[["conv_id", "call_id", "pos"]].assign(result=[None if c is None else canonical(c) for c in pdf["content"]])


def link(spark, calls, results, schemas):
    """One row per call, and per result without a call, in columns:

    conv_id, call_id, name, status (``ok``, ``no_result``, ``no_call``), valid, errors, refs (identifiers used), dangling (those
    that the conversation does not have), cyclic, place (from 1, in topological order of the conversation's calls; NULL without
    a call), line (canonical JSON of call and result), calls and results (rows with this identifier).

    ``calls``: conv_id, call_id, pos, name, arguments (JSON text); ``results``: conv_id, call_id, pos, content; conv_id and
    call_id are strings, pos integers. Rows without conv_id or call_id take no part. Of repeated identifiers the first row
    counts (by pos, then text), NULL positions last. NULL arguments are no JSON; NULL content is JSON null. Arguments that are
    no JSON appear as null in the line.
    """
    tables = Scratch(spark)
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = lambda df, *more: (df.where(named).groupBy("conv_id", "call_id")
                               .agg(F.min(F.struct(F.col("pos").isNull().alias("late"), "pos", *more)).alias("f"), F.count("*").alias("copies"))
                               .select("conv_id", "call_id", F.col("f.pos").alias("pos"), *[F.col(f"f.{m}").alias(m) for m in more], "copies"))
    one = tables.keep(first(calls, "name", "arguments"))
    known = tables.keep(one.select("conv_id", "call_id", F.coalesce("pos", F.lit((1 << 62))).alias("pos"), "name", "arguments")
                        .mapInPandas(_checked(schemas), "conv_id string, call_id string, pos bigint, name string, head string, errors string, refs array<string>"))
    uses = known.select("conv_id", "call_id", "pos", F.explode("refs").alias("ref"))
    ends = known.select(F.col("conv_id").alias("c"), F.col("call_id").alias("ref_id"), F.col("pos").alias("ref_pos"))
    edges = tables.keep(uses.join(ends, (F.col("conv_id") == F.col("c")) & (F.col("ref") == F.col("ref_id")), "left").drop("c"))
    order, cyclic = _order(tables, known.select("conv_id", "call_id", "pos"), edges.where("ref_pos is not null").select("conv_id", "call_id", "ref"))
    placed = _places(order)
    dangling = edges.where("ref_pos is null").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("ref")).alias("dangling"))
    answers = first(results, "content").withColumnRenamed("copies", "results")
    answers = tables.keep(answers.select("conv_id", "call_id", F.coalesce("pos", F.lit(1 << 62)).alias("pos"), "content")
                          .mapInPandas(_quoted, "conv_id string, call_id string, pos bigint, result string")
                          .join(answers.select("conv_id", "call_id", "results"), ["conv_id", "call_id"]).drop("pos"))
    key = ["conv_id", "call_id"]
    full = (known.join(one.select(*key, F.col("copies").alias("calls")), key).join(placed, key).join(dangling, key, "left").join(cyclic.withColumn("cyclic", F.lit(True)), key, "left")
            .join(answers, key, "full_outer"))
    line = F.concat("head", F.lit('"result":'), F.coalesce("result", F.lit("null")), F.lit("}"))
    none = F.array().cast("array<string>")
    return full.select("conv_id", "call_id", "name", F.when(F.col("place").isNull(), "no_call").when(F.col("results").isNull(), "no_result").otherwise("ok").alias("status"),
                       (F.col("errors") == "").alias("valid"), "errors", F.coalesce("refs", none).alias("refs"), F.coalesce("dangling", none).alias("dangling"),
                       F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "place", line.alias("line"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("results", F.lit(0)).alias("results"))


def _order(tables, nodes, edges):
    """((conv_id, call_id, pos, p, wave), calls whose references were set aside): a call comes at (p, wave).

    First p: the latest position among a call's own and those of the calls it waits for, directly or not. Calls that are moved
    to one position then get waves from 1 on: a call's wave comes after those of the calls it waits for there.
    """
    key = ["conv_id", "call_id"]
    at = nodes.select("conv_id", F.col("call_id").alias("ref"), F.col("pos").alias("ref_pos"))
    e = tables.keep(edges.join(nodes, key).join(at, ["conv_id", "ref"]))
    moved = tables.keep(e.where("ref_pos >= pos").groupBy(*key, "pos").agg(F.max("ref_pos").alias("p")))
    dirty = moved
    while not dirty.isEmpty():
        pull = (e.join(dirty.select("conv_id", F.col("call_id").alias("ref"), "p"), ["conv_id", "ref"]).where("p >= pos").groupBy(*key, "pos").agg(F.max("p").alias("p")))
        dirty = tables.keep(pull.join(moved.select(*key, F.col("p").alias("was")), key, "left").where("was is null or p > was").drop("was"))
        moved = tables.keep(moved.join(dirty.select(*key), key, "left_anti").unionByName(dirty))
    cyclic = moved.limit(0).select(*key)
    there = moved.select("conv_id", F.col("call_id").alias("ref"), F.col("p").alias("q"))
    waits = tables.keep(e.select(*key, "ref").join(moved.select(*key, "pos", "p"), key).join(there, ["conv_id", "ref"]).where("p = q").drop("q"))
    waves, open_, wave = nodes.limit(0).select(*key, F.lit(0).alias("wave")), moved.select(*key), 1
    while not open_.isEmpty():
        ready = tables.keep(open_.join(waits.select(*key), key, "left_anti").withColumn("wave", F.lit(wave)))
        if ready.isEmpty():  # each place that is stuck lets go of one call
            both = waits.join(waits.select("conv_id", F.col("ref").alias("call_id")).distinct(), key, "left_semi")
            loose = tables.keep(both.groupBy("conv_id", "p").agg(F.min(F.struct("pos", "call_id")).alias("m")).select("conv_id", "m.call_id"))
            cyclic = cyclic.unionByName(loose)
            waits = tables.keep(waits.join(loose, key, "left_anti"))
            continue
        waves, wave = waves.unionByName(ready), wave + 1
        open_ = tables.keep(open_.join(ready, key, "left_anti"))
        waits = tables.keep(waits.join(ready.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_anti"))
    now = moved.join(waves, key).select(*key, "p", "wave")
    order = nodes.join(now, key, "left").select(*key, "pos", F.coalesce("p", "pos").alias("p"), F.coalesce("wave", F.lit(0)).alias("wave"))
    return order, cyclic


def _places(order, reach=4096):
    """(conv_id, call_id, place): numbers from 1 in a conversation, by ranges of positions first."""
    d = order.withColumn("g", F.floor(F.col("p") / reach))
    sizes = d.groupBy("conv_id", "g").agg(F.count("*").alias("n"))
    offs = sizes.select("conv_id", "g", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    row = F.row_number().over(W.partitionBy("conv_id", "g").orderBy("p", "wave", "pos", "call_id"))
    return d.join(offs, ["conv_id", "g"]).select("conv_id", "call_id", (row + F.col("o")).alias("place"))
