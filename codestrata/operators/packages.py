"""What workspace packages export and what path aliases stand for.

Exports and aliases are tables of patterns. A specifier meets a pattern with a star by an equality join on its own prefixes,
so no specifier is compared with all patterns; the exact pattern wins, then the one with the longest prefix.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import cut_lineage

KEY = ["analysis_id", "import_id"]
# Conditions of an export, in the order they are tried, and configuration files, the first one first.
CONDITIONS = ["types", "import", "default", "require"]
CONFIGURATIONS = ["tsconfig.json", "jsconfig.json"]


def package_root(specifier: Column) -> Column:
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))


def workspace_packages(files: DataFrame) -> DataFrame:
    manifest = F.from_json("content", "name string, types string, module string, main string, exports string")
    rows = files.where(paths.base_name(F.col("path")) == "package.json").withColumn("m", manifest).where("m.name IS NOT NULL")
    return rows.groupBy("analysis_id", F.col("m.name").alias("package")).agg(F.max_by(F.struct(paths.parent_directory(F.col("path")).alias("folder"), "m"), "ord").alias("p")).select(
        "analysis_id", "package", "p.folder", "p.m.*")


def exports(packages: DataFrame) -> DataFrame:
    """(analysis_id, owner, key, value): the target of every exported path or pattern.

    Conditions may be nested to any depth: each round opens one level of all objects left, and the first choice at the
    outermost level wins. Null targets, lists and conditions that are not known export nothing.
    """
    opened = lambda c: F.explode(F.from_json(c, "map<string,string>")).alias("k", "value")
    row = ["analysis_id", F.col("package").alias("owner")]
    place = F.array_position(F.array(*[F.lit(c) for c in CONDITIONS]), F.col("k")).cast("int")
    plain = packages.where("exports LIKE '.%'").select(*row, F.lit(".").alias("key"), F.array().cast("array<int>").alias("choice"), F.col("exports").alias("value"))
    listed = packages.where("exports LIKE '{%'").select(*row, opened("exports"))
    by_path = listed.where("k LIKE '.%'").select("analysis_id", "owner", F.col("k").alias("key"), F.array().cast("array<int>").alias("choice"), "value")
    by_condition = listed.where("k NOT LIKE '.%'").select("analysis_id", "owner", F.lit(".").alias("key"), F.array(place).alias("choice"), "value").where("choice[0] > 0")
    rows = cut_lineage(plain.unionByName(by_path).unionByName(by_condition))
    found = rows.where("value LIKE '.%'")
    while not (nested := rows.where("value LIKE '{%'")).isEmpty():
        inner = nested.select("analysis_id", "owner", "key", "choice", opened("value")).withColumn("place", place).where("place > 0")
        rows = cut_lineage(inner.select("analysis_id", "owner", "key", F.concat("choice", F.array("place")).alias("choice"), "value"))
        found = found.unionByName(rows.where("value LIKE '.%'"))
    return found.groupBy("analysis_id", "owner", "key").agg(F.min_by("value", "choice").alias("value"))


def matched(asked: DataFrame, patterns: DataFrame) -> DataFrame:
    """(analysis_id, import_id, value, star) of the pattern each request means. asked: analysis_id, import_id, owner, request;
    patterns: analysis_id, owner, key, value."""
    request, key = F.col("request"), F.col("key")
    exact = asked.join(patterns.where(~key.contains("*")).withColumn("request", key), ["analysis_id", "owner", "request"]).select(
        *KEY, "value", F.lit("").alias("star"), F.lit(1).alias("exact"), F.length("key").alias("size"), "key")
    starred = patterns.where(key.contains("*")).withColumn("prefix", F.substring_index("key", "*", 1)).withColumn("suffix", F.expr("substring(key, length(prefix) + 2)"))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("request")), lambda n: F.substring(request, F.lit(1), n))
    open_ends = asked.withColumn("prefix", F.explode(prefixes)).join(starred, ["analysis_id", "owner", "prefix"])
    fits = open_ends.where(request.endswith(F.col("suffix")) & (F.length("request") >= F.length("prefix") + F.length("suffix")))
    star = F.expr("substring(request, length(prefix) + 1, length(request) - length(prefix) - length(suffix))")
    wild = fits.select(*KEY, "value", star.alias("star"), F.lit(0).alias("exact"), F.length("prefix").alias("size"), "key")
    best = exact.unionByName(wild).groupBy(*KEY).agg(F.max_by(F.struct("value", "star"), F.struct("exact", "size", F.length("key"), "key")).alias("b"))
    return best.select(*KEY, "b.value", "b.star")


def entries(bare: DataFrame, files: DataFrame) -> DataFrame:
    """(analysis_id, import_id, folder, entry): what a specifier means in the workspace package of its name. A package that
    lists exports gives nothing else; others give any path, and their own entry for the bare name."""
    packages = cut_lineage(workspace_packages(files))
    asked = bare.withColumn("package", package_root(F.col("specifier"))).join(packages, ["analysis_id", "package"])
    asked = asked.withColumn("request", F.concat(F.lit("."), F.expr("substring(specifier, length(package) + 1)")))
    closed = asked.where("exports IS NOT NULL").select(*KEY, F.col("package").alias("owner"), "folder", "request")
    listed = closed.join(matched(closed.drop("folder"), exports(packages)), KEY).select(*KEY, "folder", F.replace("value", F.lit("*"), F.col("star")).alias("entry"))
    free = asked.where("exports IS NULL").select(*KEY, "folder", F.when(F.col("request") != ".", F.col("request")).otherwise(F.coalesce("types", "module", "main", F.lit("./index"))).alias("entry"))
    return listed.unionByName(free)


def configurations(files: DataFrame) -> DataFrame:
    """(analysis_id, owner, base, paths): aliases by folder; ``base`` is null without a base URL. Comments are allowed,
    settings taken over from another file by ``extends`` are not followed."""
    shape = "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"
    order = F.array_position(F.array(*[F.lit(c) for c in CONFIGURATIONS]), paths.base_name(F.col("path")))
    rows = files.withColumn("place", order).where("place > 0").withColumn("c", F.from_json("content", shape, {"allowComments": "true"}))
    return rows.groupBy("analysis_id", paths.parent_directory(F.col("path")).alias("owner")).agg(F.min_by("c.compilerOptions", "place").alias("c")).select(
        "analysis_id", "owner", F.col("c.baseUrl").alias("base"), F.col("c.paths").alias("paths"))


def aliased(bare: DataFrame, files: DataFrame) -> DataFrame:
    """(analysis_id, import_id, owner, base, targets, star) by the nearest configuration above each import's file; targets are
    null where no alias fits."""
    known = cut_lineage(configurations(files))
    parts = F.split(paths.parent_directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = bare.select(*KEY, "specifier", F.explode(F.array_distinct(F.concat(F.array(F.lit(".")), above))).alias("owner"))
    depth = F.when(F.col("owner") == ".", 0).otherwise(F.size(F.split("owner", "/")))
    nearest = folders.join(known, ["analysis_id", "owner"]).groupBy(*KEY).agg(
        F.max_by(F.struct("owner", "base", F.col("specifier").alias("request")), depth).alias("n")).select(*KEY, "n.*")
    patterns = known.select("analysis_id", "owner", F.explode("paths").alias("key", "value"))
    hits = matched(nearest.select(*KEY, "owner", "request"), patterns).withColumnRenamed("value", "targets")
    return nearest.drop("request").join(hits, KEY, "left")
