"""Connectors to a git repository that driver and executors can open at the same path.

Lists of names (tags, heads, commits) are read by one process on the driver;
commit records, diffs and blobs are read on the executors, one process a
range or batch.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import readers


class GitError(RuntimeError):
    pass


def run(repo: str, *args: str, check: bool = True, stdin: bytes | None = None, timeout: float = 600) -> bytes:
    p = subprocess.run(["git", "-C", repo, *args], input=stdin, capture_output=True, timeout=timeout)
    if check and p.returncode:
        raise GitError(f"git {args[0]}: {p.stderr.decode(errors='replace').strip()}")
    return p.stdout


def tags(spark: SparkSession, repo: str, pattern: str = "*", by: str = "version") -> DataFrame:
    """release, created: newest version first, or newest creation date first."""
    rows = [tuple(r.split("\t")) for r in run(repo, "for-each-ref", "--format=%(refname:short)\t%(creatordate:iso-strict)", f"refs/tags/{pattern}").decode().splitlines()]
    df = spark.createDataFrame(rows, "release string, created string")
    return df.orderBy(F.desc("created"), "release") if by == "created" else df.orderBy(F.desc(X.version(F.regexp_replace("release", "^v", ""))))


def heads(spark: SparkSession, repo: str) -> DataFrame:
    """ref, sha of local and fetched branches."""
    rows = [tuple(r.split(" ", 1)) for r in run(repo, "for-each-ref", "--format=%(refname) %(objectname)", "refs/heads", "refs/remotes").decode().splitlines()]
    return spark.createDataFrame(rows, "ref string, sha string")


#: Commits whose records one git process reads.
RANGE = 5000


def log(spark: SparkSession, repo: str, *revspec: str, paths: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """Commits as readers.COMMIT, newest first by seq.

    The driver lists the commits' names alone; the records are read in ranges
    of RANGE commits on the executors.
    """
    names = run(repo, "rev-list", *([f"--max-count={limit}"] if limit else []), *(revspec or ("HEAD",)), *(["--", *paths] if paths else [])).decode().split()
    ranges = [(i, "\n".join(names[i : i + RANGE])) for i in range(0, len(names), RANGE)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, some in zip(pdf["seq"], pdf["names"], strict=True):
                raw = run(repo, "log", "--no-walk=unsorted", "--stdin", "--format=%H%x1f%P%x1f%aI%x1f%s%x1f%b%x1e", stdin=f"{some}\n".encode())
                records = raw.decode(errors="replace").split("\x1e")[:-1]
                yield pd.DataFrame({"seq": range(at, at + len(records)), "value": records})

    lists = spark.createDataFrame(ranges, "seq long, names string").repartition(max(1, len(ranges)))
    return readers.commits(lists.mapInPandas(read, "seq long, value string"))


def rev_parse(repo: str, ref: str) -> str:
    return run(repo, "rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()


def exists(repo: str, ref: str) -> bool:
    try:
        return bool(rev_parse(repo, ref))
    except GitError:
        return False


def clone(url: str, target: str, blobless: bool = True, timeout: float = 3600) -> str:
    """Clone without a work tree's history of blobs, which are then fetched as they are read; returns the folder."""
    args = ["git", "clone", "--quiet", "--no-checkout", *(["--filter=blob:none"] if blobless else []), "--", url, target]
    p = subprocess.run(args, capture_output=True, timeout=timeout)
    if p.returncode:
        raise GitError(f"git clone: {p.stderr.decode(errors='replace').strip()}")
    return target


def remote_heads(spark: SparkSession, repo: str, remote: str = "origin", pattern: str = "*") -> DataFrame:
    """ref, sha of a remote's branches, as it lists them."""
    rows = [tuple(reversed(r.split("\t", 1))) for r in run(repo, "ls-remote", "--heads", remote, pattern).decode().splitlines()]
    return spark.createDataFrame(rows, "ref string, sha string")


def is_shallow(repo: str) -> bool:
    return run(repo, "rev-parse", "--is-shallow-repository").strip() == b"true"


def blobs(objects: DataFrame, repo: str, sha: str = "sha", path: str = "path") -> DataFrame:
    """objects with ``text`` (null if absent): one ``cat-file`` process a partition."""
    schema = f"{sha} string, {path} string, text string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = run(repo, "cat-file", "--batch", stdin="".join(f"{s}:{p}\n" for s, p in zip(pdf[sha], pdf[path], strict=True)).encode())
            texts, at = [], 0
            for _ in range(len(pdf)):
                end = out.index(b"\n", at)
                head = out[at:end].split()
                at = end + 1
                if head[-1] == b"missing" or len(head) != 3:
                    texts.append(None)
                else:
                    n = int(head[2])
                    texts.append(out[at : at + n].decode(errors="replace"))
                    at += n + 1
            yield pd.DataFrame({sha: pdf[sha], path: pdf[path], "text": texts})

    return objects.select(sha, path).mapInPandas(read, schema)


def files(spark: SparkSession, repo: str, ref: str, prefixes: tuple[str, ...] = (), suffix: str = "") -> DataFrame:
    """path, text of the files at a commit."""
    from ..operators.hunks import paths

    names = [(ref, p) for p in run(repo, "ls-tree", "-r", "--name-only", "-z", ref).decode(errors="replace").split("\0") if p]
    return blobs(paths(spark.createDataFrame(names, "sha string, path string"), prefixes, suffix), repo).select("path", "text")


def diffs(windows: DataFrame, repo: str, context: int = 6, paths: tuple[str, ...] = ()) -> DataFrame:
    """windows with ``diff`` between base and tip, or of the tip alone where base is null; a window that git can't diff has a null diff and stops no other."""
    names = windows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields) + ", diff string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b, t in zip(pdf["base"], pdf["tip"], strict=True):
                try:
                    what = ["show", "--format=", "-M"] if b is None or b != b else ["diff", "-M"]
                    out.append(run(repo, *what, f"-U{context}", *([] if what[0] == "show" else [b]), t, *(["--", *paths] if paths else [])).decode(errors="replace"))
                except (GitError, subprocess.TimeoutExpired):
                    out.append(None)
            yield pdf[names].assign(diff=out)

    return windows.mapInPandas(read, schema)
