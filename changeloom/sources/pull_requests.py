"""Pull-request JSON, as it comes from a code host, to columns. What fetches a page is passed in, so nothing here opens a connection."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import paths as P

PAGE = 500


def reference(url: Column) -> Column:
    """(host, project, repo, id) of a pull-request URL of the form scheme://host/.../projects/KEY/repos/slug/pull-requests/N; nulls where it isn't one."""
    shape = r"(?i)^(https?://[^/?#]+(?:/[^?#]*?)?)/(?:projects|users)/([^/]+)/repos/([^/]+)/pull-requests/(\d+)(?:[/?#].*)?$"
    part = lambda i: F.nullif(F.regexp_extract(F.trim(url), shape, i), F.lit(""))
    return F.struct(part(1).alias("host"), part(2).alias("project"), part(3).alias("repo"), part(4).try_cast("int").alias("id"))


def clone_url(ref: Column) -> Column:
    return F.concat(ref["host"], F.lit("/scm/"), F.lower(ref["project"]), F.lit("/"), ref["repo"], F.lit(".git"))


def remote_identity(url: Column) -> Column:
    """(project, repo) in lower case of a remote's URL: /scm/ and /projects/ paths, and ssh."""
    u = F.regexp_replace(F.lower(F.trim(url)), r"(\.git)?/*$", "")
    shape = r"(?:/scm/|/projects/|^ssh://[^/]+/|^[^/@]+@[^:/]+:)([^/]+)/(?:repos/)?([^/?#]+)"
    return F.struct(F.nullif(F.regexp_extract(u, shape, 1), F.lit("")).alias("project"), F.nullif(F.regexp_extract(u, shape, 2), F.lit("")).alias("repo"))


def metadata(raw: Column) -> Column:
    """(state, title, author, target_branch) of a pull request's JSON; a field of another kind is null."""
    get = lambda p: F.get_json_object(raw, p)
    target = F.coalesce(get("$.toRef.displayId"), F.regexp_replace(get("$.toRef.id"), "^refs/heads/", ""))
    author = F.coalesce(get("$.author.user.displayName"), get("$.author.user.name"))
    return F.struct(F.upper(get("$.state")).alias("state"), get("$.title").alias("title"), author.alias("author"), target.alias("target_branch"))


def changed_paths(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """(path) of all pages of a change list, once for each path in any case; a path is toString, or its components joined."""
    item = "struct<path:struct<toString:string,components:array<string>>>"
    v = pages.select(F.explode(F.from_json(raw, f"struct<values:array<{item}>>")["values"]).alias("v"))
    path = F.coalesce(F.col("v.path.toString"), F.array_join("v.path.components", "/"))
    return v.select(P.normal(path).alias("path")).where("path != ''").dropDuplicates(["path"]).groupBy(F.upper("path")).agg(F.min("path").alias("path")).select("path")


def fetch_pages(spark: SparkSession, fetch: Callable[[int], str]) -> DataFrame:
    """(raw) of all pages: fetch(start) gives a page's JSON, until the last or one that doesn't go on."""
    start, pages = 0, []
    while True:
        raw = fetch(start)
        pages.append((raw,))
        page = json.loads(raw)
        after = page.get("nextPageStart")
        if page.get("isLastPage", True) or not isinstance(after, int) or after <= start:
            break
        start = after
    return spark.createDataFrame(pages, "raw string")


def merge_commit(metadata_json: str | None, activities_json: str | None) -> str | None:
    """The merge commit's hash: from the pull request's properties, else from its first MERGED activity."""
    import re

    def look(x: object) -> str | None:
        if isinstance(x, dict):
            for k in ("id", "hash"):
                if isinstance(x.get(k), str) and re.fullmatch(r"[0-9a-fA-F]{7,40}", x[k]):
                    return x[k]
            x = list(x.values())
        return next((r for v in x if (r := look(v))), None) if isinstance(x, list) else None

    def load(raw: str | None) -> dict:
        try:
            got = json.loads(raw or "{}")
        except ValueError:
            return {}
        return got if isinstance(got, dict) else {}

    props = load(metadata_json).get("properties")
    found = look(props.get("mergeCommit")) if isinstance(props, dict) else None
    if found:
        return found
    merged = next((a for a in load(activities_json).get("values") or [] if isinstance(a, dict) and a.get("action") == "MERGED"), None)
    return look(merged.get("commit")) or look(merged) if merged else None


def closest_solution(changed: DataFrame, solutions: DataFrame) -> DataFrame:
    """(repo_id, path) of the solution file that most changed paths lie under: each path votes for the nearest folder above it that has one.

    Ties go to the deeper, then to the name that sorts first. changed, solutions: (repo_id, path). A repeated path votes once.
    Paths are counted by folder before the folders are looked up, so what is exploded, joined and sorted is the folders, not the paths.
    """
    parts = F.split(P.normal(F.col("path")), "/")
    folders = changed.select("repo_id", "path").distinct().groupBy("repo_id", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("of")).agg(F.count("*").alias("n"))
    above = P.ancestors(F.concat("of", F.lit("/")))
    sln = solutions.groupBy("repo_id", P.directory(F.col("path")).alias("dir")).agg(F.min("path").alias("sln"))
    up = folders.select("repo_id", "of", "n", F.posexplode(above).alias("away", "dir"))
    near = up.join(sln.select("repo_id", "dir"), ["repo_id", "dir"]).groupBy("repo_id", "of", "n").agg(F.min("away").alias("away"))
    votes = near.groupBy("repo_id", F.get(above, F.col("away")).alias("dir")).agg(F.sum("n").alias("n")).join(sln, ["repo_id", "dir"])
    depth = F.size(F.split("sln", "/"))
    return votes.groupBy("repo_id").agg(F.min(F.struct((-F.col("n")).alias("n"), (-depth).alias("d"), F.upper("sln").alias("u"), "sln")).alias("m")).select("repo_id", F.col("m.sln").alias("path"))
