"""Versioned storage of project documents: each commit writes a new folder of files and then creates one numbered pointer; readers follow the highest pointer.

Pointers are created exclusively and never changed, so exactly one of two commits on the same version wins, and a reader
sees the old or the new version and nothing between. A crash before the pointer is written leaves the old version
current, a crash after it the new one. An empty pointer is a commit under way; after GRACE seconds it counts as one that
crashed. recover() drops folders that no pointer names, but none that a live writer may still be filling. Other files in
a project's folder are left alone. Paths go through Hadoop's file systems, so any store that Spark writes will do.
"""

from __future__ import annotations

import os
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from lorekeep.operators import document

NAME = re.compile(r"^[^\W_][\w.]*(?<![. ])$")
FILE = re.compile(r"^[\w][\w.-]*$")
#: Names of a document's files, fixed values: the data, and four to read.
DATA = "memory.json"
READABLE = {"context": "PROJECT_CONTEXT.md", "decisions": "DECISIONS.md", "tasks": "TASKS.md", "agents": "AGENTS.md"}
GRACE = 60.0


class Stale(RuntimeError):
    """Another commit came first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _folder(self, project: str) -> str:
        if not NAME.match(project) or ".." in project:
            raise ValueError(f"not a project name: {project!r}")
        return project

    def _names(self, *parts: str) -> dict[str, float]:
        """What lies in a folder, and when each was last changed."""
        fs, p = self._fs(), self._path(*parts)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}

    def _no_links(self, project: str) -> None:
        fs = self._fs()
        for parts in [(project,), *((project, n) for n in self._names(project))]:
            p = self._path(*parts)
            # a local folder is the driver's own; other file systems say so themselves
            if os.path.islink(p.toUri().getPath()) if fs.getScheme() == "file" else fs.exists(p) and fs.getFileLinkStatus(p).isSymlink():
                raise ValueError(f"a link is no place for documents: {p}")

    def _get(self, *parts: str) -> str:
        stream = self._fs().open(self._path(*parts))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, text: str, *parts: str) -> None:
        out = self._fs().create(self._path(*parts), False)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()

    def _pointers(self, project: str) -> list[tuple[int, str, float]]:
        """(number, version or '', age in seconds), the highest first."""
        found = sorted(((int(n[2:]), n, at) for n, at in self._names(project).items() if re.fullmatch(r"P-\d+", n)), reverse=True)
        return [(k, self._get(project, n).strip(), time.time() - at) for k, n, at in found]

    def version(self, project: str) -> str | None:
        """The current version's folder name; None if there is none."""
        return next((v for _, v, _ in self._pointers(self._folder(project)) if v), None)

    def files(self, project: str) -> dict[str, str] | None:
        """The current files by name."""
        v = self.version(project)
        return None if v is None else {n: self._get(project, v, n) for n in self._names(project, v) if not n.startswith(".")}

    def load(self, project: str) -> tuple[DataFrame, DataFrame, str] | None:
        """The stored document and its items, brought up to the present version, and the folder they are from. What is broken, or of another project, is an error."""
        v = self.version(project)
        if v is None:
            return None
        raw = self.spark.createDataFrame([(project, self._get(project, v, DATA))], "project string, content string")
        broken = document.document_errors(raw).limit(5).collect()
        if broken:
            raise ValueError(f"{project}: " + "; ".join(f"{r['place']} {r['rule']}".strip() for r in broken))
        own = raw.selectExpr("get_json_object(content, '$.project')").first()[0]
        if own != project:
            raise ValueError(f"{project} holds the document of {own}")
        return *document.read_documents(raw), v

    def projects(self) -> list[str]:
        return sorted(n for n in self._names() if NAME.match(n) and self._names(n) and self.version(n) is not None)

    def only_project(self) -> str | None:
        """The stored project, if there is exactly one."""
        own = self.projects()
        return own[0] if len(own) == 1 else None

    def commit(self, project: str, files: dict[str, str], based_on: str | None) -> str:
        """Write files as a new version on top of based_on (None: the first). Raises Stale, and leaves everything as it was, if another version is current or being made."""
        self._folder(project)
        bad = [n for n in files if not FILE.match(n)]
        if bad:
            raise ValueError(f"not a file name: {bad[0]!r}")
        self._no_links(project)
        new, fs = f"v-{uuid.uuid4().hex}", self._fs()
        fs.mkdirs(self._path(project, new))
        try:
            for name, text in files.items():
                self._put(text, project, new, name)
            pointers = self._pointers(project)
            if any(not v and age < GRACE for _, v, age in pointers) or next((v for _, v, _ in pointers if v), None) != based_on:
                raise Stale(f"{project} has changed")
            try:
                self._put(new, project, f"P-{pointers[0][0] + 1 if pointers else 1:012d}")
            except Exception as e:
                raise Stale(f"another commit of {project} came first") from e
        except BaseException:
            fs.delete(self._path(project, new), True)
            raise
        return new

    def recover(self, project: str) -> None:
        """After a crash: folders that no pointer names, older pointers and crashed ones go, once they are older than GRACE."""
        fs, now, pointers = self._fs(), self.version(self._folder(project)), self._pointers(project)
        for n, at in self._names(project).items():
            if time.time() - at > GRACE and n.startswith("v-") and n != now:
                fs.delete(self._path(project, n), True)
        for k, v, age in pointers:
            if age > GRACE and v != now:
                fs.delete(self._path(project, f"P-{k:012d}"), False)
