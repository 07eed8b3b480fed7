"""Tables of a git repository: changes, constructs, head_files, refs, edges and blame.

The driver lists only names (commit ids, tree entries, refs); contents are read by ``git`` in tasks, a batch of names
each, so the repository must be under a path that all executors see. The command line is the only dependency.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.cluster import ship
from commitscope.functions.paths import INGEST_LOCKS, basename
from commitscope.operators import structure

BATCH, MOST_BYTES = 500, 512 << 10
STATUS = {"A": 0, "M": 1, "T": 1, "C": 1, "D": 2, "R": 3}
_CHANGE = "commit_oid string, commit_s long, author string, email string, message string, file_path string, old_path string, status int, additions long, deletions long, parent_count int, blob string"


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace')[:500]}")
    return done.stdout


def _text(x: bytes) -> str:
    return x.decode("utf-8", "replace")


def require_whole(repo: str) -> None:
    """A shallow clone has no whole history; reports over it would be wrong."""
    if git(repo, "rev-parse", "--is-shallow-repository").strip() == b"true":
        raise ValueError("the repository is shallow; fetch its whole history first (git fetch --unshallow)")


def parse_log(out: bytes) -> list[tuple]:
    """Rows of ``git log -z --raw --numstat`` output in the format of ``changes``."""
    rows: list[tuple] = []
    for chunk in out.split(b"\x01\x02")[1:]:
        head, _, body = chunk.partition(b"\x03\x04")
        oid, ts, author, email, parents, message = head.split(b"\x1f", 5)
        tokens = [t for t in body.lstrip(b"\0\n").split(b"\0")]
        entries: dict[str, list] = {}
        k = 0
        while k < len(tokens):
            t = tokens[k].lstrip(b"\n")
            if t.startswith(b":"):
                f = t.split(b" ")
                kind = chr(f[4][0])
                if kind in "RC":
                    old, new, k = _text(tokens[k + 1]), _text(tokens[k + 2]), k + 3
                else:
                    old, new, k = None, _text(tokens[k + 1]), k + 2
                if b"160000" not in (f[0][1:], f[1]):  # no submodules
                    entries[new] = [old if kind == "R" else None, STATUS.get(kind, 1), 0, 0, _text(f[3])]
            elif t.count(b"\t") >= 2:
                a, d, path = t.split(b"\t", 2)
                if path:
                    k += 1
                else:
                    path, k = tokens[k + 2], k + 3
                if (e := entries.get(_text(path))) and a != b"-":
                    e[2], e[3] = int(a), int(d)
            else:
                k += 1
        common = (_text(oid), int(ts), _text(author), _text(email), _text(message))
        n = len(parents.split())
        rows += [(*common, path, e[0], e[1], e[2], e[3], n, e[4]) for path, e in entries.items()]
    return rows


def whole(repo: str, agreed: Callable[[], bool]) -> None:
    """Fetches the whole history of a shallow clone if ``agreed()``; all branches of a single-branch clone come with it."""
    if git(repo, "rev-parse", "--is-shallow-repository").strip() == b"true" and agreed():
        if b"origin" in git(repo, "remote").split():
            git(repo, "remote", "set-branches", "origin", "*")
        git(repo, "fetch", "-q", "--unshallow")


def commits(repo: str, head: str = "HEAD", start: int | None = None, end: int | None = None) -> list[str]:
    """Commit ids in the order of the history whose author time lies in [start, end) (epoch seconds)."""
    rows = (x.split() for x in git(repo, "log", "--format=%H %at", head).decode().splitlines())
    return [oid for oid, ts in rows if (start is None or int(ts) >= start) and (end is None or int(ts) < end)]


def changes(spark: SparkSession, repo: str, head: str = "HEAD", start: int | None = None, end: int | None = None) -> DataFrame:
    """One row a commit and file against the first parent: the reports' ``changes`` and the file's blob id.

    Only commits whose author time lies in [start, end) are compared with their parents.
    """
    ship(spark)
    require_whole(repo)
    oids = commits(repo, head, start, end)
    parts = max(1, -(-len(oids) // BATCH))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fmt = "--format=tformat:%x01%x02%H%x1f%at%x1f%aN%x1f%aE%x1f%P%x1f%B%x03%x04"
            out = git(repo, "log", "--no-walk=unsorted", "--stdin", "-z", "--raw", "--numstat", "-M", "--no-abbrev", "--root", "--diff-merges=first-parent", fmt, data="\n".join(frame["oid"]).encode())
            yield pd.DataFrame(parse_log(out), columns=[x.split()[0] for x in _CHANGE.split(", ")])

    named = spark.createDataFrame([(x,) for x in oids], "oid string").repartition(parts)
    rows = named.mapInPandas(run, _CHANGE).filter(~basename(F.col("file_path")).isin(*INGEST_LOCKS))
    return rows.withColumn("commit_ts", F.timestamp_seconds("commit_s")).drop("commit_s")


def constructs(spark: SparkSession, repo: str, rows: DataFrame) -> DataFrame:
    """``(commit_oid, file_path, qualified_name, kind, lines_touched)`` of the blobs of ``changes`` rows.

    As the stored hunk of a change is its first ``additions`` lines, the constructs are those that begin there.
    """
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for r, text in zip(frame.itertuples(), blobs(repo, frame["blob"], MOST_BYTES), strict=True):
                if text is not None:
                    found += [(r.commit_oid, r.file_path, i.qualified, i.kind, i.end - i.start + 1) for i in structure.items(r.file_path, _text(text)) if i.start <= r.additions]
            yield pd.DataFrame(found, columns=["commit_oid", "file_path", "qualified_name", "kind", "lines_touched"])

    known = F.lower(F.substring_index("file_path", ".", -1)).isin(*structure.EXT)
    return rows.filter(known & (F.col("status") != 2)).select("commit_oid", "file_path", "additions", "blob").mapInPandas(run, "commit_oid string, file_path string, qualified_name string, kind string, lines_touched long")


def blobs(repo: str, oids, most: int | None = None) -> Iterator[bytes | None]:
    """Contents by blob id, in order; None for what is no blob. Blobs over ``most`` bytes are not read, and None as well."""
    oids = list(oids)
    if most is not None and oids:
        kinds = git(repo, "cat-file", "--batch-check=%(objecttype) %(objectsize)", data="\n".join(oids).encode() + b"\n").splitlines()
        small = [k[:5] == b"blob " and int(k[5:]) <= most for k in kinds]
        read = blobs(repo, [o for o, s in zip(oids, small, strict=True) if s])
        yield from (next(read) if s else None for s in small)
        return
    out = git(repo, "cat-file", "--batch", data="\n".join(oids).encode() + b"\n") if oids else b""
    at = 0
    for _ in oids:
        end = out.index(b"\n", at)
        head = out[at:end].split(b" ")
        if head[-1] == b"missing":
            at = end + 1
            yield None
            continue
        size = int(head[2])
        yield out[end + 1 : end + 1 + size] if head[1] == b"blob" else None
        at = end + 2 + size


def decoded(data: bytes) -> tuple[str | None, bool]:
    """(text, binary): binary with a NUL byte in the first 8 KiB or where the bytes are no UTF-8; then there is no text."""
    try:
        return (None, True) if b"\0" in data[:8192] else (data.decode("utf-8"), False)
    except UnicodeDecodeError:
        return None, True


def head_files(spark: SparkSession, repo: str, head: str = "HEAD", most: int = 20 << 20) -> DataFrame:
    """``(path, oid, size, binary, content)`` of the tree's blobs.

    ``size`` is the blob's own; blobs over ``most`` bytes, more than any report reads, are not read and have no content.
    """
    ship(spark)
    entries = []
    for line in git(repo, "ls-tree", "-r", "-l", "-z", head).split(b"\0"):
        if line:
            meta, _, path = line.partition(b"\t")
            mode, kind, oid, size = meta.split()
            if kind == b"blob" and mode != b"120000":  # no symbolic links
                entries.append((_text(path), oid.decode(), int(size)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = 0
            while at < len(frame):  # up to 64 files and about 64 MB at a time
                end = at + max(1, int((frame["size"].iloc[at : at + 64].clip(upper=most).cumsum() <= 64 << 20).sum()))
                part = frame.iloc[at:end]
                found = [decoded(x) if x is not None else (None, False) for x in blobs(repo, part["oid"], most)]
                yield part.assign(binary=[b for _, b in found], content=[t for t, _ in found])
                at = end

    named = spark.createDataFrame(entries, "path string, oid string, size long").repartition(max(1, -(-len(entries) // BATCH)))
    return named.mapInPandas(run, "path string, oid string, size long, binary boolean, content string")


def refs(spark: SparkSession, repo: str) -> DataFrame:
    """``(name, last_commit, author, merged, is_head)`` of remote branches, or of local ones if there are none."""

    def listed(space: str, *extra: str) -> list[list[str]]:
        out = git(repo, "for-each-ref", "--format=%(refname)%09%(committerdate:unix)%09%(authoremail:trim)%09%(HEAD)", *extra, space).decode("utf-8", "replace")
        return [x.split("\t") for x in out.splitlines() if not x.split("\t")[0].endswith("/HEAD")]

    space = "refs/remotes" if listed("refs/remotes") else "refs/heads"
    merged = {x[0] for x in listed(space, "--merged=HEAD")}
    current = _text(git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip())
    rows = []
    for name, ts, author, _ in listed(space):
        short = name.split("/", 3)[3] if space == "refs/remotes" else name.split("/", 2)[2]
        rows.append((short, int(ts or 0), author, "yes" if name in merged else "no", "yes" if short == current else "no"))
    df = spark.createDataFrame(rows, "name string, ts long, author string, merged string, is_head string")
    return df.select("name", F.to_date(F.timestamp_seconds("ts")).alias("last_commit"), "author", "merged", "is_head")


def edges(spark: SparkSession, repo: str, head: str = "HEAD") -> DataFrame:
    """``(oid, parent)`` of the commits reachable from ``head``."""
    rows = [(x[0], p) for x in (line.split() for line in git(repo, "rev-list", "--parents", head).decode().splitlines()) for p in x[1:]]
    return spark.createDataFrame(rows, "oid string, parent string")


def blame(spark: SparkSession, repo: str, paths: DataFrame) -> DataFrame:
    """``(path, line_start, len, author, commit_ts)`` of ``paths(path)`` at HEAD; a task blames a few files."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                yield pd.DataFrame(parse_blame(path, git(repo, "blame", "--porcelain", "HEAD", "--", path)), columns=["path", "line_start", "len", "author", "s"])

    rows = paths.select("path").mapInPandas(run, "path string, line_start long, len long, author string, s long")
    return rows.withColumn("commit_ts", F.timestamp_seconds("s")).drop("s")


def parse_blame(path: str, out: bytes) -> list[tuple]:
    rows, known, at = [], {}, None
    for raw in out.split(b"\n"):
        if raw.startswith(b"\t"):
            continue
        f = raw.split(b" ")
        if len(f[0]) == 40 and len(f) >= 3:
            at = f[0]
            known.setdefault(at, ["", 0])
            if len(f) == 4:
                rows.append((at, int(f[2]), int(f[3])))
        elif at and f[0] == b"author-mail":
            known[at][0] = _text(raw[12:]).strip("<>")
        elif at and f[0] == b"author-time":
            known[at][1] = int(f[1])
    return [(path, start, n, *known[oid]) for oid, start, n in rows]


# Folders that are no part of a composition of files on disk.
SKIPPED_DIRS = [
    # version control
    ".git", ".hg", ".svn",
    # dependencies and output
    "node_modules", "target", "dist", "build", "out",
    # Python
    ".venv", "venv", "__pycache__",
    # web frameworks, caches, editors
    ".next", ".nuxt", ".cache", ".gradle", ".idea", ".vscode",
    # others' code
    "vendor", "bower_components",
]


def files_on_disk(spark: SparkSession, root: str, most: int = 2 << 20) -> DataFrame:
    """``(path, size, binary, content)`` of a folder's files, for compositions without a history; larger ones are left out.

    Symbolic links are not followed where the folder is on a local disk.
    """
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    found = found.filter((F.col("length") > 0) & (F.col("length") <= most)).select(inner.alias("path"), F.col("length").alias("size"), "content")
    found = found.filter(~F.col("path").rlike(r"(^|/)(" + "|".join(re.escape(x) for x in SKIPPED_DIRS) + r")/"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[[not _linked(root, x) for x in frame["path"]]]
            texts = [decoded(x) for x in frame["content"]]
            yield frame.assign(binary=[b for _, b in texts], content=[t for t, _ in texts])

    return found.mapInPandas(run, "path string, size long, content string, binary boolean")


def _linked(root: str, path: str) -> bool:
    at = Path(root)
    return any((at := at / part).is_symlink() for part in path.split("/"))


def git_folder(repo: str) -> dict[str, int]:
    """Bytes of the git folder, its pack files and its loose objects."""
    top = Path(_text(git(repo, "rev-parse", "--absolute-git-dir").strip()))
    size = sum(x.lstat().st_size for x in top.rglob("*") if not x.is_dir())
    packs = sum(x.suffix.lower() == ".pack" for x in (top / "objects/pack").glob("*"))
    loose = sum(1 for d in (top / "objects").glob("[0-9a-fA-F][0-9a-fA-F]") for _ in d.iterdir())
    return {"bytes": size, "packs": packs, "loose": loose}
