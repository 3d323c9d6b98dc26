"""Backward slices from failure points, for many reports at once.

Within a function, statements are read from the failure upwards: a statement that defines what a later one
needs joins the slice, and its own needs with it. This depends on the order of lines, so a function is one group
(a function's statements are few); all else - parameters to callers, returned values to callees, shared state -
is a join a hop. Statements seen once aren't entered again.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.graph import cut_lineage
from causeway.operators.joins import range_join
from causeway.operators.ranking import topk

HOPS, CALLERS, SHARED = 4, 3, 8
#: What an operation on memory makes of a definition.
OF_MEMORY = {"allocation": "allocation_site", "reallocation": "allocation_site", "deallocation": "deallocation_site", "set": "initialization_site", "copy": "initialization_site"}
_EDGE = "bug_id string, source string, target string, relation string, entity string"
_ARITHMETIC = re.compile(r"[\w)]\s*(?:<<|>>|[-+/%*])\s*[\w(]")


def _list(v) -> list[str]:
    return [] if v is None or isinstance(v, float) else list(v)


def _relation(row, entity: str) -> str:
    kinds = _list(row.statement_types)
    left, eq, right = row.text.partition("=")
    if "return" in kinds:
        return "return_value"
    if eq and _ARITHMETIC.search(re.sub(r"\(\s*[A-Za-z_][\w\s*]*\)", "", right)):
        return "integer_influence"
    if eq and ("->" in left or "." in left or "[" in left or left.strip().startswith("*")):
        return "state_update"
    return "data_dependence"


def _needs(row) -> list[str]:
    return list(dict.fromkeys([*_list(row.referenced), *_list(row.index_variables), *_list(row.field_accesses)] + ([row.alias_source] if isinstance(row.alias_source, str) else [])))


def _scan(group: pd.DataFrame) -> pd.DataFrame:
    """One function seen from one statement: edges into it, and what is wanted from elsewhere (relations in angle brackets)."""
    rows = list(group.sort_values("line").itertuples(index=False))
    first = rows[0]
    bug, seed = first.bug_id, first.seed
    at = next(i for i, r in enumerate(rows) if r.statement_id == seed)
    wanted: dict[str, dict[str, None]] = {}
    edges: dict[tuple[str, str, str, str], None] = {}

    def want(names, consumer: str) -> None:
        for n in names:
            wanted.setdefault(n, {})[consumer] = None

    want([*_list(first.entities), *_needs(rows[at])], seed)
    chosen = {seed}
    for r in reversed(rows[:at]):
        found = {e: _relation(r, e) for e in _list(r.defined) if e in wanted}
        for kind, target in zip(_list(r.memory_kinds), _list(r.memory_targets), strict=True):
            if target in wanted:
                found[target] = OF_MEMORY.get(kind, "heap_object")
        for e in _list(r.field_accesses):
            if e in wanted and e.split(".")[-1] in _list(r.defined):
                found.setdefault(e, "heap_object")
        if not found:
            continue
        chosen.add(r.statement_id)
        for e, relation in found.items():
            for consumer in wanted[e]:
                edges[r.statement_id, consumer, relation, e] = None
        want(_needs(r), r.statement_id)
    depth = {r.statement_id: (r.line, r.block_depth) for r in rows}
    for r in rows[:at]:
        if "condition" not in _list(r.statement_types):
            continue
        guarded = [s for s in chosen if depth[s][0] > r.line and depth[s][1] > r.block_depth]
        for s in guarded:
            edges[r.statement_id, s, "control_dependence", r.condition or ""] = None
        if guarded:
            want(_list(r.referenced), r.statement_id)
    for p in _list(first.parameters):
        for consumer in wanted.get(p, {}):
            edges["", consumer, "<parameter>", p] = None
    local = {d for r in rows for d in _list(r.defined)} | set(_list(first.parameters))
    for e in wanted:
        if e not in local and "." not in e:
            for consumer in wanted[e]:
                edges["", consumer, "<shared>", e] = None
    for s in chosen:
        edges["", s, "<called>", ""] = None
    return pd.DataFrame([(bug, *k) for k in edges], columns=["bug_id", "source", "target", "relation", "entity"])


def locate(triggers: DataFrame, functions: DataFrame, statements: DataFrame, reach: int = 5) -> DataFrame:
    """(bug_id, repo_id, function_id, statement_id): the statement of a failure, else the nearest one of its function."""
    ranges = functions.select("repo_id", "file", "function_id", F.col("line").alias("first"), F.col("end_line").alias("last"))
    inside = range_join(triggers, ranges, ["repo_id", "file"], "line", "first", "last", [F.col("last") - F.col("first"), "first"], ["bug_id"]).where("function_id is not null")
    near = inside.select("bug_id", "repo_id", "function_id", F.col("line").alias("at")).join(statements.select("repo_id", "function_id", "statement_id", "line"), ["repo_id", "function_id"])
    near = near.withColumn("gap", F.abs(F.col("line") - F.col("at"))).where(F.col("gap") <= reach)
    return topk(near, ["bug_id"], ["gap", "line"], 1).select("bug_id", "repo_id", "function_id", "statement_id")


def backward(triggers: DataFrame, facts: dict[str, DataFrame], hops: int = HOPS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) in the form of plans.rank: triggers are (bug_id, repo_id, file, line), facts from lexer.tables()."""
    functions, statements, calls = facts["functions"], facts["statements"], facts["calls"]
    start = cut_lineage(locate(triggers, functions, statements))
    seeds = start.select("bug_id", "repo_id", "function_id", F.col("statement_id").alias("seed"), F.array().cast("array<string>").alias("entities"))
    seen = seeds.select("bug_id", "seed")
    body = statements.join(functions.select("repo_id", "function_id", "parameters"), ["repo_id", "function_id"])
    home = statements.select("repo_id", "statement_id", F.col("function_id").alias("home"), "file")
    edges = None
    for hop in range(hops + 1):
        held = seeds.join(body, ["repo_id", "function_id"])
        raw = cut_lineage(held.groupBy("bug_id", "function_id", "seed").applyInPandas(_scan, _EDGE))
        real = raw.where("source <> ''")
        edges = real if edges is None else edges.unionByName(real)
        if hop == hops:
            break
        of = start.select("bug_id", "repo_id")
        asked = raw.where("source = ''").drop("source").join(of, "bug_id").join(home.select("repo_id", F.col("statement_id").alias("target"), "home", "file"), ["repo_id", "target"])
        # parameters: what callers pass at the same place; nearby callers first, those of tests last
        place = functions.select("repo_id", F.col("function_id").alias("home"), F.posexplode("parameters").alias("pos", "entity"))
        passed = asked.where("relation = '<parameter>'").join(place, ["repo_id", "home", "entity"]).join(calls.select("repo_id", F.col("target").alias("home"), F.col("statement_id").alias("source"), F.col("function_id").alias("from"), F.col("file").alias("call_file"), "arguments"), ["repo_id", "home"])
        passed = passed.withColumn("argument", F.get("arguments", F.col("pos"))).where("argument is not null").withColumn("far", F.levenshtein("file", "call_file"))
        passed = topk(passed, ["bug_id", "home", "entity", "target"], [F.when(F.lower("call_file").contains("test"), 1).otherwise(0), "far", "source"], CALLERS)
        into = passed.select("bug_id", "repo_id", "source", "target", F.lit("call_argument").alias("relation"), "entity", F.col("from").alias("function_id"), F.regexp_extract_all("argument", F.lit(r"[A-Za-z_]\w*"), F.lit(0)).alias("entities"))
        # returned values: the returns of the one function that a call means
        meant = calls.where("target is not null").select("repo_id", F.col("target").alias("fid"), F.col("statement_id").alias("stmt"), F.col("callee").alias("name"))
        meant = meant.select("repo_id", F.col("stmt").alias("target"), F.col("fid").alias("callee"), "name")
        called = asked.where("relation = '<called>'").join(meant, ["repo_id", "target"]).select("bug_id", "repo_id", "target", "callee", "name")
        returns = statements.where(F.array_contains("statement_types", "return")).select("repo_id", F.col("function_id").alias("callee"), F.col("statement_id").alias("source"))
        back = called.join(returns, ["repo_id", "callee"]).select("bug_id", "repo_id", "source", "target", F.lit("return_value").alias("relation"), F.col("name").alias("entity"), F.col("callee").alias("function_id"), F.array().cast("array<string>").alias("entities"))
        # shared state: definitions of the name in other functions of the repository, a few of them
        writes = statements.select("repo_id", F.col("statement_id").alias("source"), F.col("function_id").alias("from"), F.explode("defined").alias("entity"))
        shared = asked.where("relation = '<shared>'").join(writes, ["repo_id", "entity"]).where("`from` <> home")
        shared = topk(shared, ["bug_id", "target", "entity"], ["source"], SHARED).select("bug_id", "repo_id", "source", "target", F.lit("global_state").alias("relation"), "entity", F.col("from").alias("function_id"), F.array("entity").alias("entities"))
        steps = cut_lineage(into.unionByName(back).unionByName(shared))
        edges = cut_lineage(edges.unionByName(steps.select(*edges.columns)))
        new = steps.groupBy("bug_id", "repo_id", "function_id", F.col("source").alias("seed")).agg(F.array_distinct(F.flatten(F.collect_list("entities"))).alias("entities")).join(seen, ["bug_id", "seed"], "left_anti")
        seeds = cut_lineage(new.select("bug_id", "repo_id", "function_id", "seed", "entities"))
        if seeds.isEmpty():
            break
        seen = seen.unionByName(seeds.select("bug_id", "seed"))
    edges = edges.dropDuplicates(["bug_id", "source", "target", "relation", "entity"]).withColumn("approximated", F.lit(True))
    used = edges.select("bug_id", F.col("source").alias("statement_id"), "entity").unionByName(edges.select("bug_id", F.col("target").alias("statement_id"), "entity")).unionByName(start.select("bug_id", "statement_id", F.lit(None).cast("string").alias("entity")))
    tracked = used.groupBy("bug_id", "statement_id").agg(F.sort_array(F.collect_set("entity")).alias("tracked_entities"))
    nodes = tracked.join(start.select("bug_id", "repo_id"), "bug_id").join(statements, ["repo_id", "statement_id"]).join(start.select("bug_id", "statement_id", F.lit(True).alias("is_trigger")), ["bug_id", "statement_id"], "left")
    nodes = nodes.select("bug_id", F.col("statement_id").alias("node_id"), "file", F.col("line").cast("int").alias("line"), "func", "text", "statement_types", "tracked_entities", "defined", "referenced", "calls", F.col("memory_kinds").alias("memory"), F.coalesce("is_trigger", F.lit(False)).alias("is_trigger"))
    return nodes, edges

