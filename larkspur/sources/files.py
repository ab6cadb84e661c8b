"""Files of any store: local paths, or URIs that Arrow's file systems open.  Discovery of inputs."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Callable

#: Extensions of tables and of label catalogs.
TABLE_EXT, CATALOG_EXT = ".sas7bdat", ".sas7bcat"


def opener(path: str) -> Callable[[int, int], bytes]:
    """read(offset, n) -> bytes, fewer at the end of the file."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        handle = store.open_input_file(inner)
    else:
        handle = open(path.removeprefix("file://"), "rb")  # noqa: SIM115

    def read(offset: int, n: int) -> bytes:
        handle.seek(offset)
        return handle.read(n)

    return read


def memory(data: bytes) -> Callable[[int, int], bytes]:
    return lambda offset, n: data[offset : offset + n]


def discover(paths: list[str], ext: str = TABLE_EXT, *, skip: list[str] | None = None, pattern: str | None = None) -> list[str]:
    """Tables below paths: recursive, links not followed, extension in any case, missing paths ignored, sorted, once.

    skip: names of files that are left out; pattern: a regular expression that the path must match somewhere.
    """
    found: set[str] = set()
    for path in paths:
        if "://" in path and not path.startswith("file://"):
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            info = store.get_file_info(inner)
            scheme = path.split("://")[0]
            if info.type == fs.FileType.File:
                found.add(path)
            elif info.type == fs.FileType.Directory:
                found |= {f"{scheme}://{x.path}" for x in store.get_file_info(fs.FileSelector(inner, recursive=True)) if x.path.lower().endswith(ext)}
            continue
        path = path.removeprefix("file://")
        if os.path.isfile(path):
            if path.lower().endswith(ext):
                found.add(path)
        else:
            for top, _, names in os.walk(path, followlinks=False):
                found |= {os.path.join(top, n) for n in names if n.lower().endswith(ext)}
    out = sorted(found)
    if skip:
        out = [p for p in out if os.path.basename(p) not in skip]
    return [p for p in out if re.search(pattern, p)] if pattern else out


def download(url: str, folder: str) -> str:
    """A file fetched from an address (http, https, file) into folder; its path."""
    from urllib.parse import unquote, urlparse
    from urllib.request import urlopen

    out = os.path.join(folder, os.path.basename(unquote(urlparse(url).path)) or "download")
    with urlopen(url) as src, open(out, "wb") as dst:
        while chunk := src.read(1 << 20):
            dst.write(chunk)
    return out


def pair_files(sources: list[str], root: str, others: list[str], other_roots: list[str]) -> dict[str, tuple[str | None, str | None]]:
    """source -> (its partner, note): by the same relative path below one of other_roots, else by base name in any case."""
    stem = lambda p: os.path.splitext(p)[0]
    by_path = {(r, stem(os.path.relpath(o, r))): o for r in other_roots for o in others if not os.path.relpath(o, r).startswith("..")}
    by_name: dict[str, list[str]] = {}
    for o in others:
        by_name.setdefault(os.path.basename(stem(o)).lower(), []).append(o)
    out: dict[str, tuple[str | None, str | None]] = {}
    for s in sources:
        inner = stem(os.path.relpath(s, root))
        same = next((by_path[r, inner] for r in other_roots if (r, inner) in by_path), None)
        named = by_name.get(os.path.basename(inner).lower(), [])
        if same:
            out[s] = same, None
        elif named:
            out[s] = named[0], "several by name" if len(named) > 1 else "by name"
        else:
            out[s] = None, None
    return out


def extract_table(archive: str, folder: str) -> str:
    """First table in a ZIP archive, written to folder; its path."""
    with zipfile.ZipFile(archive) as z:
        for name in sorted(z.namelist()):
            if name.lower().endswith(TABLE_EXT):
                out = os.path.join(folder, os.path.basename(name))
                with z.open(name) as src, open(out, "wb") as dst:
                    while chunk := src.read(1 << 20):
                        dst.write(chunk)
                return out
    raise FileNotFoundError(f"no table in {archive}")
