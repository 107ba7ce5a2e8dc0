"""Files that appear all at once: tasks write below a run folder, a manifest names what counts.

A run's tasks write to ``run-<id>/<task>-<attempt>/``. The commit stores a numbered
manifest with the task folders that succeeded, and publishes it by one rename;
until then, and if anything fails before, readers see the last manifest's files.
What no manifest names any more is removed last, so a failure there loses nothing.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import WriterCommitMessage

_NAME = re.compile(r"manifest-(\d{9})\.json")


@dataclass
class TaskFolder(WriterCommitMessage):
    name: str  # below the sink's folder
    files: int


def task_folder(run: str) -> str:
    """Where the running task attempt writes, below the sink's folder."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"run-{run}/{context.partitionId():06d}-{context.attemptNumber()}"


def _load(fs: pafs.FileSystem, path: str) -> dict:
    with fs.open_input_file(path) as file:
        return json.loads(file.read().decode("utf-8"))


def _manifests(fs: pafs.FileSystem, folder: str) -> list[tuple[int, str]]:
    """(number, path) of a folder's manifests, the newest last."""
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        return []
    infos = fs.get_file_info(pafs.FileSelector(folder))
    found = [(m, i.path) for i in infos if (m := _NAME.fullmatch(i.base_name))]
    return sorted((int(m.group(1)), path) for m, path in found)


def publish(fs: pafs.FileSystem, folder: str, content: dict, number: int, run: str) -> None:
    """Stores a manifest under a hidden name and gives it its own by one rename."""
    staged = posixpath.join(folder, f".manifest-{run}")
    with fs.open_output_stream(staged) as out:
        out.write(json.dumps(content).encode("utf-8"))
    fs.move(staged, posixpath.join(folder, f"manifest-{number:09d}.json"))


def commit(
    fs: pafs.FileSystem, folder: str, run: str, messages: Sequence[TaskFolder | None], overwrite: bool, suffix: str
) -> None:
    """Publishes a run's files, after or in place of what the folder holds."""
    fs.create_dir(folder, recursive=True)
    before = _manifests(fs, folder)
    kept = _load(fs, before[-1][1]) if before else {"folders": [], "loose": []}
    if not before:
        infos = fs.get_file_info(pafs.FileSelector(folder))
        kept["loose"] = [i.base_name for i in infos if i.base_name.endswith(suffix) and i.type == pafs.FileType.File]
    new = [m.name for m in messages if m and m.files]
    content = {"folders": new, "loose": []} if overwrite else {**kept, "folders": [*kept["folders"], *new]}
    publish(fs, folder, content, before[-1][0] + 1 if before else 0, run)
    for _, path in before:
        fs.delete_file(path)
    if overwrite:
        for name in kept["loose"]:
            fs.delete_file(posixpath.join(folder, name))
        for name in sorted({f.split("/")[0] for f in kept["folders"]}):
            fs.delete_dir(posixpath.join(folder, name))


def abort(fs: pafs.FileSystem, folder: str, run: str) -> None:
    """Removes whatever a failed run has written."""
    path = posixpath.join(folder, f"run-{run}")
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def counted(fs: pafs.FileSystem, infos: Iterable[pafs.FileInfo]) -> list[pafs.FileInfo]:
    """Of listed files those that count: in folders with manifests, what the newest one names."""
    infos = list(infos)
    newest: dict[str, str] = {}
    for info in infos:
        if _NAME.fullmatch(info.base_name):
            folder = posixpath.dirname(info.path)
            newest[folder] = max(newest.get(folder, ""), info.path)
    named = {}
    for folder, path in newest.items():
        content = _load(fs, path)
        named[folder] = {*content["loose"], *content["folders"]}

    def counts(info: pafs.FileInfo) -> bool:
        parent = posixpath.dirname(info.path)
        if parent in named:
            return info.base_name in named[parent]
        run = posixpath.dirname(parent)
        top = posixpath.dirname(run)
        if top in named and posixpath.basename(run).startswith("run-"):
            return posixpath.relpath(parent, top) in named[top]
        return True

    return [i for i in infos if counts(i)]
