"""Files of a source: local paths, downloads, archives."""

from __future__ import annotations

import http.client
import os
import shutil
import urllib.error
import urllib.request
import zipfile
from pathlib import Path

TIMEOUT = 30
CHUNK = 1 << 16
#: Times that a transfer is begun or gone on with.
ATTEMPTS = 4


def locate(folder: str | Path, name: str) -> Path:
    """The file called ``name`` in a folder or below it, least path first."""
    found = sorted(p for p in Path(folder).rglob(Path(name).name) if p.is_file())
    if not found:
        raise FileNotFoundError(f"{name} is not in {folder}")
    return found[0]


def unpack(archive: Path, folder: Path, name: str) -> Path:
    """The file ``name`` of a ZIP archive, extracted unless a newer copy is there."""
    try:
        old = locate(folder, name)
        if old.stat().st_mtime >= archive.stat().st_mtime:
            return old
    except FileNotFoundError:
        pass
    folder.mkdir(parents=True, exist_ok=True)
    root = folder.resolve()
    with zipfile.ZipFile(archive) as held:
        for item in held.infolist():
            target = (root / item.filename).resolve()
            if not target.is_relative_to(root):
                raise ValueError(f"{item.filename!r} would leave {folder}")
            if not item.is_dir():
                target.parent.mkdir(parents=True, exist_ok=True)
                with held.open(item) as src, open(target, "wb") as dst:
                    shutil.copyfileobj(src, dst)
                os.utime(target)
    return locate(folder, name)


def download(url: str, target: Path, opener=urllib.request.urlopen) -> Path:
    """``url`` as a file, fetched again only if its size differs.

    A transfer that breaks off goes on where it stopped, if the server gives
    ranges and what it has is still the same (its ETag or date of change says
    so); else it begins anew.  A file shorter than announced is never taken.
    """
    if target.exists():
        with opener(urllib.request.Request(url, method="HEAD"), timeout=TIMEOUT) as head:
            if head.headers.get("Content-Length") == str(target.stat().st_size):
                return target
    target.parent.mkdir(parents=True, exist_ok=True)
    part, mark = (target.with_name(f"{target.name}{end}") for end in (".part", ".part.version"))
    for attempt in range(ATTEMPTS):
        try:
            _fetch(url, part, mark, opener)
            break
        except (OSError, http.client.HTTPException) as why:
            if isinstance(why, urllib.error.HTTPError) and why.code == 416:  # there is no such range any more
                part.unlink(missing_ok=True)
            elif isinstance(why, urllib.error.HTTPError) and why.code < 500 or attempt == ATTEMPTS - 1:
                raise
    else:
        raise OSError(f"{url} cannot be fetched")
    mark.unlink(missing_ok=True)
    return part.rename(target)


def _fetch(url: str, part: Path, mark: Path, opener) -> None:
    """Fetch what ``part`` lacks; an error leaves what has come."""
    have = part.stat().st_size if part.exists() and mark.exists() else 0
    asked = urllib.request.Request(url, headers={"Range": f"bytes={have}-", "If-Range": mark.read_text()} if have else {})
    with opener(asked, timeout=TIMEOUT) as src:
        further = src.status == 206 and src.headers.get("Content-Range", "").startswith(f"bytes {have}-")
        begin = have if further else 0
        size = src.headers.get("Content-Length")
        version = src.headers.get("ETag") or src.headers.get("Last-Modified")
        if version and not version.startswith("W/"):
            mark.write_text(version)
        else:
            mark.unlink(missing_ok=True)
        with open(part, "ab" if further else "wb") as dst:
            while data := src.read(CHUNK):
                dst.write(data)
    if size is not None and part.stat().st_size != begin + int(size):
        raise OSError(f"{url}: {part.stat().st_size} of {begin + int(size)} bytes came")


def resolve(source, base: str | Path, cache: str | Path) -> Path:
    """The data file of a source: downloaded or local, taken out of its archive or folder."""
    if source.url:
        at = download(source.url, Path(cache) / source.url.rsplit("/", 1)[-1])
    else:
        at = Path(source.path) if Path(source.path).is_absolute() else Path(base) / source.path
        if not at.exists():
            raise FileNotFoundError(f"source {source.name!r}: {at} does not exist")
    if at.is_dir():
        return locate(at, source.file)
    if at.suffix.lower() == ".zip":
        return unpack(at, Path(cache) / at.stem, source.file)
    return at
