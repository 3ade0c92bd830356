"""What a snapshot is made of: dependencies, frameworks, entry points, routes, counts."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.ranking import top_per_group
from ..schemas import CODE_LANGUAGES

# Names reported when they are dependencies or appear in build files.
NODE_FRAMEWORKS = ["react", "next", "express", "fastify", "vue", "svelte", "@nestjs/core"]
PYTHON_FRAMEWORKS = ["django", "fastapi", "flask", "starlette"]
NODE_INTEGRATIONS = ["mongodb", "mongoose", "prisma", "@prisma/client", "pg", "redis", "ioredis", "passport", "next-auth", "@auth/core", "stripe",
                     "firebase", "@supabase/supabase-js"]
PYTHON_INTEGRATIONS = ["sqlalchemy", "psycopg", "psycopg2", "pymongo", "celery", "redis", "boto3", "requests", "httpx"]
BUILD_FRAMEWORKS = [("spring-boot", "Spring Boot"), ("quarkus", "Quarkus"), ("micronaut", "Micronaut")]
BUILD_INTEGRATIONS = [("spring-boot-starter-data-jpa", "Spring Data JPA"), ("spring-boot-starter-security", "Spring Security"), ("hibernate", "Hibernate"),
                      ("postgresql", "PostgreSQL"), ("mysql", "MySQL"), ("kafka", "Kafka"), ("redis", "Redis")]
# One whole JSON object; text after it makes the manifest unreadable.
WHOLE_OBJECT = r"^\s*\{[\s\S]*\}\s*$"
PACKAGE_JSON = ("dependencies map<string,string>, devDependencies map<string,string>, main string, module string, browser string")


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("name", F.lower(paths.base_name(F.col("path"))))


def _bare(requirement: Column) -> Column:
    return F.regexp_extract(requirement, r"^([^\[=><]*)", 1)


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """Distinct (analysis_id, dependency) declared by the manifests of a snapshot."""
    named = _named(files)
    package = (paths.base_name(F.col("path")) == "package.json") & F.col("content").rlike(WHOLE_OBJECT)
    parsed = named.where(package).withColumn("j", F.from_json("content", PACKAGE_JSON))
    node = parsed.select("analysis_id", F.explode(F.concat(F.coalesce(F.map_keys("j.dependencies"), F.array().cast("array<string>")),
                                                          F.coalesce(F.map_keys("j.devDependencies"), F.array().cast("array<string>")))).alias("dependency"))
    lines = named.where("name LIKE 'requirements%' AND name LIKE '%.txt'").select("analysis_id", F.explode(F.split("content", r"\r\n|\n|\r")).alias("line"))
    plain = lines.where(F.col("line").rlike(r"^\s*[^\s#-]")).select("analysis_id", F.lower(F.trim(_bare(F.col("line")))).alias("dependency"))
    toml = named.where("name IN ('pyproject.toml', 'pipfile')")
    project = F.regexp_extract("content", r"""(?s)\[project\](?:(?!\n\[).)*?\ndependencies\s*=\s*\[((?:[^\]"']|"[^"]*"|'[^']*')*)\]""", 1)
    listed = toml.select("analysis_id", F.explode(F.regexp_extract_all(project, F.lit(r"""["']([^"']+)["']"""), F.lit(1))).alias("r")).select(
        "analysis_id", F.lower(_bare(F.col("r"))).alias("dependency"))
    keys = F.lit(r"(?m)^\s*[\"']?([A-Za-z0-9_.-]+)[\"']?\s*=")
    section = lambda title: F.regexp_extract("content", rf"(?s)(?:^|\n)\[{title}\]((?:(?!\n\[).)*)", 1)
    poetry = toml.select("analysis_id", F.explode(F.regexp_extract_all(section(r"tool\.poetry\.dependencies"), keys, F.lit(1))).alias("dependency"))
    pip = [toml.select("analysis_id", F.explode(F.regexp_extract_all(section(s), keys, F.lit(1))).alias("d")).select("analysis_id", F.lower("d").alias("dependency"))
           for s in ("packages", "dev-packages")]
    return reduce(DataFrame.unionByName, [node, plain, listed, poetry, *pip]).where("dependency <> ''").distinct()


def detected(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Distinct (analysis_id, kind, label): frameworks and integrations seen in manifests, imports and build files."""
    label = lambda kind, name, when: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("label")))
    marks = [label("framework", n, F.col("dependency") == n) for n in NODE_FRAMEWORKS + PYTHON_FRAMEWORKS]
    marks += [label("integration", n, F.col("dependency") == n) for n in dict.fromkeys(NODE_INTEGRATIONS + PYTHON_INTEGRATIONS)]
    from_manifests = dependencies.select("analysis_id", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m"))
    content, build = F.col("content"), F.col("name").isin("pom.xml", "build.gradle", "build.gradle.kts")
    python, java = F.col("language") == "python", F.col("language") == "java"
    boot = content.contains("@SpringBootApplication")
    spring = java & content.contains("org.springframework")
    seen = [label("framework", n, python & (content.contains(f"import {n}") | content.contains(f"from {n}"))) for n in PYTHON_FRAMEWORKS]
    seen += [label("framework", "Spring Boot", spring & boot), label("framework", "Spring", spring & ~boot)]
    seen += [label("framework", n, build & F.lower(content).contains(marker)) for marker, n in BUILD_FRAMEWORKS]
    seen += [label("integration", n, build & F.lower(content).contains(marker)) for marker, n in BUILD_INTEGRATIONS]
    from_text = _named(files).select("analysis_id", F.explode(F.filter(F.array(*seen), lambda m: m.isNotNull())).alias("m"))
    return from_manifests.unionByName(from_text).select("analysis_id", "m.kind", "m.label").distinct()


def entry_points(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Paths a reader would start from, first seen first; all, or the first ``limit`` of each snapshot."""
    named = _named(files)
    manifest = F.when((paths.base_name(F.col("path")) == "package.json") & F.col("content").rlike(WHOLE_OBJECT),
                      F.from_json("content", PACKAGE_JSON))
    folder = paths.parent_directory(F.col("path"))
    at = lambda target: F.when(target.isNotNull(), F.regexp_replace(F.concat(F.when(folder == ".", "").otherwise(F.concat(folder, F.lit("/"))),
                                                                             F.regexp_replace(target, r"(^|/)(\./)+", "$1")), "//+", "/"))
    script = paths.stem(F.col("path")).isin("main", "index", "server", "app") & F.col("language").isin("javascript", "typescript")
    python = (F.col("language") == "python") & F.col("name").isin("main.py", "app.py", "manage.py", "asgi.py", "wsgi.py")
    java = (F.col("language") == "java") & (F.col("content").contains("@SpringBootApplication") | F.col("content").contains("static void main("))
    listed = named.withColumn("j", manifest).select("analysis_id", "ord", F.posexplode(F.array(
        at(F.col("j.main")), at(F.col("j.module")), at(F.col("j.browser")), F.when(script | python | java, F.col("path")))).alias("slot", "path"))
    first = listed.where("path IS NOT NULL").groupBy("analysis_id", "path").agg(F.min(F.struct("ord", "slot")).alias("at"))
    return top_per_group(first, ["analysis_id"], [F.col("at"), F.col("path")], limit, "place").select("analysis_id", "path", "place")


def route_table(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Handlers and routes with method and path; all, or the first ``limit`` of each snapshot. nodes carry tags and ord."""
    tagged = nodes.where(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "api-handler") | F.col("symbol_kind").isin("api-handler", "route"))
    rows = tagged.select("analysis_id", F.col("id").alias("node_id"), "path", "name", "start_line", "ord",
                         F.coalesce(F.expr("substring(get(filter(tags, t -> startswith(t, 'http:')), 0), 6)"), F.lit("ROUTE")).alias("method"),
                         F.expr("substring(get(filter(tags, t -> startswith(t, 'route:')), 0), 7)").alias("route"))
    return top_per_group(rows, ["analysis_id"], [F.col("ord"), F.col("node_id")], limit, "place")


def snapshot_counts(files: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per snapshot; each table is counted on its own, so nothing is multiplied by a join."""
    tagged = [(files, "files", F.lit(True)), (nodes, "symbols", F.col("kind") == "symbol"), (edges, "edges", F.lit(True)), (chunks, "chunks", F.lit(True))]
    parts = [frame.where(keep).groupBy("analysis_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for frame, name, keep in tagged]
    long = reduce(DataFrame.unionByName, parts)
    wide = long.groupBy("analysis_id").agg(*[F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n) for n in ("files", "symbols", "edges", "chunks")])
    languages = files.where(F.col("language").isin(CODE_LANGUAGES)).groupBy("analysis_id").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    return wide.join(languages, "analysis_id", "left")


def snapshot_warnings(files: DataFrame, diagnostics: DataFrame, unresolved: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct warnings: redacted files, diagnostics, the number of unresolved references.

    With a ``limit`` the first diagnostics of each snapshot are listed and one warning tells how many are not.
    """
    redacted = files.where("redacted").select("analysis_id", F.concat(F.lit("Secrets were masked in "), "path").alias("warning"))
    told = diagnostics.select("analysis_id", F.col("message").alias("warning"))
    if limit is not None:
        told = top_per_group(diagnostics, ["analysis_id"], [F.col("ord"), F.col("message")], limit).select("analysis_id", F.col("message").alias("warning"))
        rest = diagnostics.groupBy("analysis_id").agg((F.count("*") - limit).alias("n")).where("n > 0")
        told = told.unionByName(rest.select("analysis_id", F.concat("n", F.lit(" more diagnostics are not listed.")).alias("warning")))
    open_ends = unresolved.groupBy("analysis_id").agg(F.count("*").alias("n")).select(
        "analysis_id", F.concat("n", F.lit(" references have no target; none was made up.")).alias("warning"))
    return redacted.unionByName(told).unionByName(open_ends).distinct()
