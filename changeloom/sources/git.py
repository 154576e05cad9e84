"""Change sets from a git working copy, and whole trees from a folder.

git runs on the driver, once for each listing or range; texts are read by Spark. Every source gives the columns of model.CHANGED_FILES.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import paths as P
from changeloom.functions import text as X
from changeloom.sources import diffs

GLOBS = "*.{cs,csproj,axaml,xaml,resx}"


class GitError(RuntimeError):
    """A git command failed."""


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "core.quotepath=off", "-C", repo, *args], capture_output=True, check=False)
    if done.returncode:
        raise GitError(f"git {' '.join(args)}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode(errors="replace")


@dataclass
class SourceResult:
    files: DataFrame
    info: list[str] = field(default_factory=list)
    is_entire_repository_scan: bool = False


Source = Callable[[SparkSession], SourceResult]


def _listed(spark: SparkSession, repo: str, repo_id: str, raw: str) -> DataFrame:
    one = spark.createDataFrame([(repo_id, raw)], "repo_id string, raw string")
    return one.select("repo_id", F.explode(diffs.name_status(F.col("raw"))).alias("e")).select("repo_id", "e.status", "e.path")


def _added(spark: SparkSession, repo_id: str, raw: str, name: str) -> DataFrame:
    one = spark.createDataFrame([(repo_id, raw)], "repo_id string, raw string")
    parts = one.select("repo_id", F.explode(diffs.split_by_file(F.col("raw"))).alias("e"))
    return parts.select("repo_id", P.normal(F.col("e.path")).alias("path"), diffs.added_lines(F.col("e.diff")).alias(name))


def _texts(spark: SparkSession, repo: str, entries: DataFrame) -> DataFrame:
    """Adds full_path and text from disk; entries whose file is missing go."""
    root = str(Path(repo).resolve())
    got = entries.where(P.is_analyzable(F.col("path"))).withColumn("full_path", F.concat(F.lit(root + "/"), "path"))
    names = [r[0] for r in got.select("full_path").distinct().collect() if Path(r[0]).is_file()]  # the change set's paths
    if not names:
        return got.withColumn("text", F.lit("")).where(F.lit(False))
    disk = spark.read.format("binaryFile").load([f"file://{n}" for n in names]).select(F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/").alias("full_path"), F.decode("content", "UTF-8").alias("text"))
    return got.join(disk, "full_path")


def _finish(files: DataFrame) -> DataFrame:
    """Lines, and added lines: of an added file without a diff of its own all, else those of the diff."""
    lines = X.lines(F.col("text"))
    every = F.sequence(F.lit(1), F.size(lines))
    own = F.coalesce(F.when(F.size("added") > 0, F.col("added")), F.when(F.col("status") == "A", every), F.col("added"), F.array().cast("array<int>"))
    return files.select("repo_id", "status", "path", "full_path", "text", lines.alias("lines"), own.alias("added_lines"))


def working_tree(spark: SparkSession, repo: str, repo_id: str = "") -> SourceResult:
    """Tracked changes against HEAD, and untracked files as added."""
    tracked = _listed(spark, repo, repo_id, git(repo, "diff", "--name-status", "HEAD"))
    new = "".join(f"A\t{x}\n" for x in git(repo, "ls-files", "--others", "--exclude-standard").splitlines())
    entries = diffs.merge(tracked, _listed(spark, repo, repo_id, new)).where("status != 'D'")
    lines = _added(spark, repo_id, git(repo, "diff", "--unified=0", "HEAD"), "added")
    return SourceResult(_finish(_texts(spark, repo, entries.join(lines, ["repo_id", "path"], "left"))))


def branch(spark: SparkSession, repo: str, base: str, repo_id: str = "") -> SourceResult:
    """What HEAD has over the merge base with `base`, and what the working tree has over HEAD; the first wins for a path in both."""
    entries = diffs.merge(_listed(spark, repo, repo_id, git(repo, "diff", "--name-status", f"{base}...HEAD")).where("status != 'D'"), working_tree(spark, repo, repo_id).files.select("repo_id", "status", "path"))
    mine = _added(spark, repo_id, git(repo, "diff", "--unified=0", f"{base}...HEAD"), "a")
    tree = _added(spark, repo_id, git(repo, "diff", "--unified=0", "HEAD"), "b")
    both = entries.join(mine, ["repo_id", "path"], "left").join(tree, ["repo_id", "path"], "left")
    every = F.sequence(F.lit(1), F.size(X.lines(F.col("text"))))
    files = _texts(spark, repo, both).withColumn("added", F.coalesce(F.when(F.size("a") > 0, F.col("a")), F.when(F.col("status") == "A", every), F.col("b"), F.array().cast("array<int>")))
    return SourceResult(_finish(files))


def commit(spark: SparkSession, repo: str, sha: str, repo_id: str = "") -> SourceResult:
    """What one commit changed against its first parent; texts are those of the commit."""
    entries = _listed(spark, repo, repo_id, git(repo, "diff", "--name-status", f"{sha}^", sha)).where("status != 'D'").where(P.is_analyzable(F.col("path")))
    lines = _added(spark, repo_id, git(repo, "diff", "--unified=0", f"{sha}^", sha), "added")
    texts = [(r["path"], git(repo, "show", f"{sha}:{r['path']}")) for r in entries.select("path").collect()]  # the commit's paths
    got = spark.createDataFrame(texts, "path string, text string") if texts else spark.createDataFrame([], "path string, text string")
    root = str(Path(repo).resolve())
    return SourceResult(_finish(entries.join(got, "path").join(lines, ["repo_id", "path"], "left").withColumn("full_path", F.concat(F.lit(root + "/"), "path"))))


def repository(spark: SparkSession, repo: str, repo_id: str = "") -> SourceResult:
    """All files that git lists, or that the folder holds if it isn't a working copy: as modified, with every line added."""
    try:
        raw = "".join(f"M\t{x}\n" for x in git(repo, "ls-files", "--cached", "--others", "--exclude-standard").splitlines())
        entries = _listed(spark, repo, repo_id, raw).dropDuplicates(["path"])
        files = _texts(spark, repo, entries)
    except GitError:
        files = folder(spark, repo, repo_id)
    lines = X.lines(F.col("text"))
    files = files.select("repo_id", F.lit("M").alias("status"), "path", "full_path", "text", lines.alias("lines"), F.sequence(F.lit(1), F.size(lines)).alias("added_lines"))
    return SourceResult(files, is_entire_repository_scan=True)


def folder(spark: SparkSession, root: str, repo_id: str = "") -> DataFrame:
    """(repo_id, status, path, full_path, text) of the analyzable files under a folder of any file system that Spark reads."""
    where = root if "://" in root else f"file://{Path(root).resolve()}"
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOBS).load(where)
    prefix = where.rstrip("/").split("://", 1)[1]
    full = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*", "/")
    files = read.select(F.lit(repo_id).alias("repo_id"), F.lit("M").alias("status"), F.substring(full, F.lit(len(prefix) + 2), F.length(full)).alias("path"), full.alias("full_path"), F.decode("content", "UTF-8").alias("text"))
    return files.where(P.is_analyzable(F.col("path")))


def refreshed(spark: SparkSession, cached: DataFrame, paths: DataFrame) -> DataFrame:
    """The cached rows of some paths (repo_id, path) with their texts read again; status and added lines stay."""
    old = cached.join(paths, ["repo_id", "path"], "left_semi")
    names = [r[0] for r in old.select("full_path").collect() if Path(r[0]).is_file()]  # the files to refresh
    if not names:
        return old.where(F.lit(False))
    disk = spark.read.format("binaryFile").load([f"file://{n}" for n in names]).select(F.regexp_replace("path", "^file:/*", "/").alias("full_path"), F.decode("content", "UTF-8").alias("text"))
    new = old.drop("text", "lines").join(disk, "full_path")
    return new.withColumn("lines", X.lines(F.col("text"))).select(*cached.columns)


def branch_tips(spark: SparkSession, repo: str) -> DataFrame:
    """(commit, position, branches): HEAD's first-parent history, newest first, with the names of the branches that end there."""
    log = git(repo, "rev-list", "--first-parent", "HEAD").split()
    refs = [x.split(" ", 1) for x in git(repo, "for-each-ref", "--format=%(objectname) %(refname)", "refs/heads", "refs/remotes").splitlines()]
    history = spark.createDataFrame(list(zip(log, range(len(log)), strict=True)), "commit string, position int")
    names = spark.createDataFrame(refs or [("", "")], "commit string, ref string").select("commit", X.branch_name(F.col("ref")).alias("name")).where("name is not null")
    return history.join(names.groupBy("commit").agg(F.sort_array(F.collect_set("name")).alias("branches")), "commit", "left")
