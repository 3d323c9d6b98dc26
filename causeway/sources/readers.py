"""Readers: source trees, JSON documents and logs, advisory payloads, benchmark targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions import urls

#: Suffixes of source files and folders that are left out of a scan.
SUFFIXES = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx")
IGNORED = (".git", ".hg", ".svn", "node_modules", "build", "dist", "out", "venv", ".venv", "__pycache__", "target", "third_party", "vendor")


def source_files(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """(repo_id, path, content) of the C and C++ files below root; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + "/" + root.split(":", 1)[-1].strip("/").replace(".", r"\.") + "/", "")
    out = files.select(F.lit(repo_id).alias("repo_id"), relative.alias("path"), F.expr("try_validate_utf8(cast(content as string))").alias("content"))
    return out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object a file; anything else is an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def log(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """A JSON object a line. Tolerant reading drops lines that can't be decoded; strict reading stops at one."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def wrapped_records(spark: SparkSession, path: str, record: T.StructType, keys: tuple[str, ...] = ("records", "rcas", "entries", "patterns", "root_cause_analyses")) -> DataFrame:
    """Records of files that hold a list, or an object with a list under one of the keys."""
    text = spark.read.option("wholetext", "true").text(path)
    lists = [F.from_json("value", T.ArrayType(record))] + [F.from_json("value", T.StructType([T.StructField(k, T.ArrayType(record))]))[k] for k in keys]
    is_list = F.ltrim("value").startswith("[")
    found = F.when(is_list, lists[0]).otherwise(F.coalesce(*lists[1:]))
    return text.select(F.explode(found).alias("r")).select("r.*")


_REFERENCE = "array<struct<url:string,tags:array<string>,source:string>>"
_CONTAINER = f"struct<descriptions:array<struct<lang:string,value:string>>,problemTypes:array<struct<descriptions:array<struct<cweId:string,description:string>>>>,references:{_REFERENCE},affected:array<struct<vendor:string,product:string,versions:array<struct<version:string,lessThan:string,lessThanOrEqual:string,status:string>>>>>"
CVE_LIST = f"struct<cveMetadata:struct<cveId:string>,containers:struct<cna:{_CONTAINER},adp:array<{_CONTAINER}>>>"
NVD = f"struct<vulnerabilities:array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,weaknesses:array<struct<description:array<struct<value:string>>>>,references:{_REFERENCE}>>>>"
GITHUB = "array<struct<ghsa_id:string,cve_id:string,identifiers:array<struct<type:string,value:string>>,summary:string,description:string,source_code_location:string,references:array<string>,cwes:array<struct<cwe_id:string>>,vulnerabilities:array<struct<package:struct<name:string,ecosystem:string>,vulnerable_version_range:string,first_patched_version:string>>>>"
PROJECT = "array<struct<cve_id:string,cwes:array<string>,description:string,language:string,project:string,repo_url:string,references:array<string>>>"


def _english(d: Column) -> Column:
    best = F.filter(d, lambda x: F.lower(x["lang"]).startswith("en"))
    return F.coalesce(F.get(best, F.lit(0))["value"], F.get(d, F.lit(0))["value"])


def _record(cve: Column, description: Column, cwes: Column, refs: Column, kind: str, project: Column | None = None, repo: Column | None = None, language: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(refs, F.array().cast("array<string>")), urls.repaired), lambda u: u.rlike("^(?:https?|ftps?)://")))
    ids = F.array_distinct(F.filter(F.transform(F.coalesce(cwes, F.array().cast("array<string>")), lambda c: F.upper(F.trim(c))), lambda c: c.startswith("CWE-")))
    return [F.upper(F.trim(cve)).alias("cve_id"), description.alias("description"), ids.alias("cwes"), clean.alias("references"), (project if project is not None else none).alias("project"), (repo if repo is not None else none).alias("repo_url"), (language if language is not None else none).alias("language"), F.lit(kind).alias("source_kind")]


def cve_list(df: DataFrame, text: str) -> DataFrame:
    """Records of CVE JSON 5 texts; the numbering authority's container comes before the others."""
    v = df.select(F.from_json(text, CVE_LIST).alias("v"))
    boxes = F.concat(F.array("v.containers.cna"), F.coalesce("v.containers.adp", F.array().cast(f"array<{_CONTAINER}>")))
    flat = lambda f: F.flatten(F.filter(F.transform(boxes, f), lambda x: x.isNotNull()))
    cwes = F.transform(F.flatten(F.filter(F.transform(flat(lambda b: b["problemTypes"]), lambda p: p["descriptions"]), lambda x: x.isNotNull())), lambda x: F.coalesce(x["cweId"], F.regexp_extract(x["description"], r"(CWE-\d+)", 1)))
    refs = F.transform(flat(lambda b: b["references"]), lambda r: r["url"])
    product = F.get(flat(lambda b: b["affected"]), F.lit(0))["product"]
    return v.where("v.cveMetadata.cveId is not null").select(*_record(F.col("v.cveMetadata.cveId"), _english(flat(lambda b: b["descriptions"])), cwes, refs, "cvelist_v5", product))


_SAID = "array<struct<lang:string,value:string>>"
#: The older shape of the feed.
NVD_1 = f"struct<CVE_Items:array<struct<cve:struct<CVE_data_meta:struct<ID:string>,description:struct<description_data:{_SAID}>,problemtype:struct<problemtype_data:array<struct<description:{_SAID}>>>,references:struct<reference_data:array<struct<url:string>>>>>>>"


def nvd(df: DataFrame, text: str) -> DataFrame:
    """Records of feeds of either shape."""
    v = df.select(F.explode(F.from_json(text, NVD)["vulnerabilities"]["cve"]).alias("c")).where("c.id is not null")
    listed = lambda of: F.transform(F.flatten(F.filter(of, lambda x: x.isNotNull())), lambda x: x["value"])
    new = v.select(*_record(F.col("c.id"), _english(F.col("c.descriptions")), listed(F.col("c.weaknesses.description")), F.col("c.references.url"), "nvd"))
    w = df.select(F.explode(F.from_json(text, NVD_1)["CVE_Items"]["cve"]).alias("c")).where("c.CVE_data_meta.ID is not null")
    old = w.select(*_record(F.col("c.CVE_data_meta.ID"), _english(F.col("c.description.description_data")), listed(F.col("c.problemtype.problemtype_data.description")), F.col("c.references.reference_data.url"), "nvd"))
    return new.unionByName(old)


def affected(df: DataFrame, text: str) -> DataFrame:
    """(cve_id, cpe_uri, vendor, product, version) of all products that feeds name, however deep in their nodes, each once."""
    items = F.concat(*(F.coalesce(F.from_json(F.get_json_object(text, f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in ("vulnerabilities", "CVE_Items")))
    item = df.select(F.explode(items).alias("i"))
    cve = F.coalesce(F.get_json_object("i", "$.cve.id"), F.get_json_object("i", "$.cve.CVE_data_meta.ID"))
    nodes = F.coalesce(F.get_json_object("i", "$.cve.configurations"), F.get_json_object("i", "$.configurations"))
    names = F.array_distinct(F.regexp_extract_all(nodes, F.lit(r'"(?:criteria|cpe23Uri)"\s*:\s*"([^"\\]*)"'), F.lit(1)))
    rows = item.select(F.upper(F.trim(cve)).alias("cve_id"), F.explode(names).alias("cpe_uri")).where("cve_id is not null")
    return rows.select("cve_id", "cpe_uri", urls.cpe(F.col("cpe_uri")).alias("c")).select("cve_id", "cpe_uri", "c.*")


def github_advisories(df: DataFrame, text: str) -> DataFrame:
    """Advisories with a CVE id; others are left out."""
    v = df.select(F.explode(F.from_json(text, GITHUB)).alias("a"))
    listed = F.get(F.filter("a.identifiers", lambda i: i["type"] == "CVE")["value"], F.lit(0))
    cve = F.coalesce("a.cve_id", listed)
    return v.where(cve.isNotNull()).select(*_record(cve, F.coalesce("a.description", "a.summary"), F.col("a.cwes.cwe_id"), F.col("a.references"), "github_advisory", F.get(F.col("a.vulnerabilities.package.name"), F.lit(0)), F.col("a.source_code_location")))


def project_advisories(df: DataFrame, text: str) -> DataFrame:
    """Records of a list, of an object that holds one, or of a single object."""
    wrapped = F.from_json(text, f"struct<records:{PROJECT}>")["records"]
    alone = F.from_json(F.concat(F.lit("["), F.col(text), F.lit("]")), PROJECT)
    v = df.select(F.explode(F.when(F.ltrim(text).startswith("["), F.from_json(text, PROJECT)).otherwise(F.coalesce(wrapped, alone))).alias("a")).where("a.cve_id is not null")
    return v.select(*_record(F.col("a.cve_id"), F.col("a.description"), F.col("a.cwes"), F.col("a.references"), "project_advisory", F.col("a.project"), F.col("a.repo_url"), F.col("a.language")))


#: Records of all payload kinds, one union.
def records(**payloads: DataFrame) -> DataFrame:
    read = {"cve_list": cve_list, "nvd": nvd, "github": github_advisories, "project": project_advisories}
    out = None
    for kind, df in payloads.items():
        part = read[kind](df, df.columns[0])
        out = part if out is None else out.unionByName(part)
    return out


def git_commits(commits: DataFrame, terms: list[str]) -> DataFrame:
    """Commits (repo, sha, message, diff) whose message names one of the terms, whatever the case."""
    pattern = "(?i)(?:" + "|".join(r"\Q" + x + r"\E" for x in terms) + ")"
    return commits.where(F.col("message").rlike(pattern))


def touched_files(patches: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, file) of each file a patch changes."""
    names = F.regexp_extract_all(text, F.lit(r"(?m)^\+\+\+ (?:b/)?(\S+)"), F.lit(1))
    return patches.select(*ids, F.explode(F.array_distinct(names)).alias("file")).where("file <> '/dev/null'")
