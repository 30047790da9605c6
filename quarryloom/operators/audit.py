"""Dependency audits: advisories, groups, fixes, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryloom.functions.text import lookup

# The order of severities.
SEVERITY = {"critical": 4, "high": 3, "moderate": 2, "medium": 2, "low": 1, "info": 0, "unknown": -1}
_REPORT = "struct<vulnerabilities:map<string,struct<severity:string,range:string,isDirect:boolean,fixAvailable:string,via:array<string>>>>"
_ADVISORY = "struct<source:string,title:string,severity:string,range:string,url:string>"


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup({k: str(v) for k, v in SEVERITY.items()}, F.lower(severity)).cast("int"), F.lit(-1))


def advisories(audits: DataFrame, direct: DataFrame, *, key: str = "audit_id", report: str = "report") -> DataFrame:
    """audits: key, report (JSON); direct: key, package, version (direct dependencies).  A row for each advisory object of
    each vulnerable package, or one for a package without any.  `via` may hold names as well as objects, and `fixAvailable` may be a flag."""
    parsed = audits.select(key, F.from_json(report, _REPORT).alias("r")).select(key, F.explode("r.vulnerabilities").alias("package", "v"))
    objects = F.transform(F.filter(F.coalesce("v.via", F.array().cast("array<string>")), lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, _ADVISORY))
    one = F.when(F.size(objects) > 0, objects).otherwise(F.array(F.lit(None).cast(_ADVISORY)))
    patched = F.nullif(F.trim(F.get_json_object("v.fixAvailable", "$.version")), F.lit(""))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = parsed.select(key, "package", "v", F.posexplode(one).alias("nth", "a")).select(
        key, "package", "nth", F.coalesce(blank("a.severity"), blank("v.severity"), F.lit("unknown")).alias("severity"), F.coalesce(blank("a.range"), blank("v.range"), F.lit("unknown")).alias("vulnerable_range"),
        patched.alias("patched_version"), F.coalesce("v.isDirect", F.lit(False)).alias("flagged"), F.coalesce(blank("a.title"), F.concat("package", F.lit(" vulnerability"))).alias("title"), F.col("a.url").alias("url"), F.col("a.source").alias("advisory_id"),
    )
    # advisories pass by a table of the direct dependencies, few and short, and are not sorted: a task holds none of them
    named = direct.select(key, "package", F.col("version").alias("spec")).hint("shuffle_hash")
    return rows.join(named, [key, "package"], "left").select(
        key, "package", "nth", F.coalesce("spec", F.lit("unknown")).alias("current_version"), "severity", "vulnerable_range", "patched_version", (F.col("flagged") | F.col("spec").isNotNull()).alias("is_direct"), "title", "url", "advisory_id",
    )


def by_package(found: DataFrame, *, key: str = "audit_id") -> DataFrame:
    """Direct packages: how many advisories, the highest severity (the first of equals), the first patched version."""
    d = found.where("is_direct")
    return d.groupBy(key, "package").agg(
        F.count(F.lit(1)).alias("advisories"), F.min_by("current_version", "nth").alias("current_version"), F.max_by("severity", F.struct(severity_rank(F.col("severity")), -F.col("nth"))).alias("severity"),
        F.min_by("patched_version", F.when(F.col("patched_version").isNotNull(), F.col("nth"))).alias("patched_version"),
    )


def select_fix(found: DataFrame, queries: DataFrame, *, key: str = "audit_id") -> DataFrame:
    """The advisory to fix: direct, with a patch; of packages that the query names if it names any; worst first."""
    e = found.where(F.col("is_direct") & F.col("patched_version").isNotNull()).join(queries, key)
    named = e.withColumn("named", F.lower(F.coalesce("query", F.lit(""))).contains(F.lower("package"))).withColumn("any_named", F.max(F.col("named").cast("int")).over(Window.partitionBy(key)))
    w = Window.partitionBy(key).orderBy(F.desc(severity_rank(F.col("severity"))), F.lower("package"), F.lower("title"), "nth")
    return named.where(F.col("named") | (F.col("any_named") == 0)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "named", "any_named")


def resolved_versions(direct: DataFrame, lock_packages: DataFrame, lock_dependencies: DataFrame, *, key: str = "audit_id") -> DataFrame:
    """Versions of the lock file's package list, else of its dependency list, else the manifest's."""
    a = lock_packages.select(key, F.regexp_extract("name", "^node_modules/(.*)$", 1).alias("package"), F.nullif("version", F.lit("")).alias("v1"))
    b = lock_dependencies.select(key, F.col("name").alias("package"), F.nullif("version", F.lit("")).alias("v2"))
    first = F.coalesce("v1", "version")
    return direct.join(a, [key, "package"], "left").join(b, [key, "package"], "left").select(key, "package", F.when(first == F.col("version"), F.coalesce("v2", first)).otherwise(first).alias("version"))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.  `try_parse_json` reads the first value alone, so the text is read inside a list and inside an
    object: more than one value, or a bracket too many, breaks at least one of them."""
    whole = lambda before, after: F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull()
    return whole("[", "\n]") & whole('{"":', "\n}")


def rebuild(chunks: DataFrame, *, key: str = "file_path") -> DataFrame:
    """chunks: key, start_line, ord, content.  Files from chunks that may overlap: of each line the first chunk's text; complete if no line is missing."""
    lines = chunks.select(key, "start_line", "ord", F.posexplode(F.split(F.regexp_replace("content", "\n$", ""), "\n")).alias("i", "line"))
    numbered = lines.withColumn("n", F.col("start_line") + F.col("i"))
    first = numbered.groupBy(key, "n").agg(F.min_by("line", F.struct("start_line", "ord")).alias("line"))
    joined = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"), F.max("n").alias("last"), F.count(F.lit(1)).alias("lines"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return joined.select(key, text.alias("content"), (F.col("lines") == F.col("last")).alias("is_complete")).withColumn("is_json", is_json(F.col("content")))


def bump(manifests: DataFrame, fixes: DataFrame, *, key: str = "audit_id") -> DataFrame:
    """manifests: key, content; fixes: key, package, patched_version.  The first line of each package that names a version,
    with the new one: indent, ^ or ~ and comma stay; lines that would not change are left out."""
    lines = manifests.select(key, F.posexplode(F.split("content", "\r?\n")).alias("i", "line"))
    pattern = r'^(\s*)"([^"]+)"\s*:\s*"([^"]+)"(,?)\s*$'
    g = lambda k: F.regexp_extract("line", pattern, k)
    named = lines.where(F.col("line").rlike(pattern)).select(key, (F.col("i") + 1).alias("line_number"), "line", g(1).alias("indent"), g(2).alias("package"), g(3).alias("spec"), g(4).alias("comma"))
    first = named.join(fixes, [key, "package"]).withColumn("_r", F.row_number().over(Window.partitionBy(key, "package").orderBy("line_number"))).where("_r = 1")
    prefix = F.when(F.col("patched_version").rlike("^[~^]"), "").otherwise(F.regexp_extract("spec", "^([~^]?)", 1))
    new = F.concat("indent", F.lit('"'), "package", F.lit('": "'), prefix, "patched_version", F.lit('"'), "comma")
    return first.select(key, "package", "line_number", F.col("line").alias("old_code"), new.alias("new_code")).where("old_code != new_code")
