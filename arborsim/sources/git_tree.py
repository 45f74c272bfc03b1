"""Files of a git repository's HEAD commit as a Spark data source, by way of the git command.

``spark.read.format("git_tree").option("path", repo).load()`` gives path, blob_sha and content. Listing is done
once on the driver; contents are read on executors, in slices of the list, and only if asked for
(``.option("content", "false")`` leaves them null); ``contents`` reads those of chosen hashes. The repository must
be reachable from the executors.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arborsim.schema import BLOBS


def _git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], input=data, capture_output=True)
    if done.returncode:
        raise OSError(done.stderr.decode(errors="replace").strip())
    return done.stdout


def find_repo(path: str | None = None) -> str:
    """The work tree's or git folder's root: of path, or $ARBORSIM_CWD, or the current folder; looks upward."""
    at = path or os.environ.get("ARBORSIM_CWD") or os.getcwd()
    try:
        return _git(at, "rev-parse", "--absolute-git-dir").decode().rstrip("\n")
    except OSError as e:
        raise ValueError(f"not in a git repository: {at}") from e


def walk_tree(repo: str) -> list[tuple[str, str]]:
    """(path, blob_sha) of the blobs of HEAD, symbolic links among them; none before the first commit."""
    try:
        out = _git(repo, "ls-tree", "-r", "-z", "--full-tree", "HEAD")
    except OSError:
        if subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True).returncode:
            return []
        raise
    rows = []
    for entry in filter(None, out.split(b"\0")):
        head, path = entry.split(b"\t", 1)
        _, kind, sha = head.decode().split(" ")
        if kind == "blob":
            rows.append((path.decode(errors="replace"), sha))
    return rows


def read_blobs(repo: str, shas: list[str]) -> Iterator[bytes]:
    """Contents in order, through one process."""
    with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        for sha in shas:
            p.stdin.write(sha.encode() + b"\n")
            p.stdin.flush()
            head = p.stdout.readline().split()
            if len(head) != 3:
                raise ValueError(f"no such blob: {sha}")
            yield p.stdout.read(int(head[2]))
            p.stdout.read(1)
        p.stdin.close()


def read_blob(repo: str, sha: str) -> str:
    """A blob's text; errors for a malformed hash, a missing blob and bytes that aren't UTF-8."""
    if len(sha) != 40 or set(sha) - set("0123456789abcdef"):
        raise ValueError(f"invalid sha: {sha}")
    return next(read_blobs(repo, [sha])).decode()


class Slice(InputPartition):
    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = rows


class GitTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo = find_repo(options.get("path"))
        self.content = str(options.get("content", "true")).lower() != "false"
        self.size = int(options.get("slice", "2000"))

    def partitions(self) -> list[Slice]:
        rows = walk_tree(self.repo)
        return [Slice(rows[i : i + self.size]) for i in range(0, len(rows), self.size)] or [Slice([])]

    def read(self, part: Slice) -> Iterator[tuple]:
        data = read_blobs(self.repo, [s for _, s in part.rows]) if self.content else iter([None] * len(part.rows))
        for (path, sha), content in zip(part.rows, data):
            yield path, sha, content


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return BLOBS

    def reader(self, schema) -> GitTreeReader:
        return GitTreeReader(self.options)


def read(spark, path: str | None = None, content: bool = True):
    spark.dataSource.register(GitTree)
    return spark.read.format("git_tree").option("path", find_repo(path)).option("content", str(content).lower()).load()


def contents(shas: DataFrame, path: str | None = None) -> DataFrame:
    """blob_sha, content of each row of shas(blob_sha), read on the executors that hold the rows."""
    repo = find_repo(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(read_blobs(repo, some.column(0).to_pylist())), pa.binary())], names=["blob_sha", "content"])

    return shas.select("blob_sha").mapInArrow(run, "blob_sha string, content binary")


def make(path: str, files: Iterator[tuple[str, bytes]]) -> str:
    """A new bare repository at the path with one commit of the files (path, content), through one git process."""
    subprocess.run(["git", "init", "-q", "--bare", path], check=True, capture_output=True)
    _git(path, "symbolic-ref", "HEAD", "refs/heads/main")
    with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", path, "fast-import", "--quiet"], stdin=subprocess.PIPE) as p:
        p.stdin.write(b"commit refs/heads/main\ncommitter arborsim <arborsim@example.com> 0 +0000\ndata 0\n")
        for name, data in files:
            p.stdin.write(b"M 100644 inline %b\ndata %d\n%b\n" % (name.encode(), len(data), data))
        p.stdin.close()
    if p.returncode:
        raise OSError(f"git fast-import ended with {p.returncode}")
    return path
