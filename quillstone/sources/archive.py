"""Archives of a store: a ZIP of its folder, read-only once packed."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile

from quillstone.errors import InvalidContainer

SUFFIX = ".qz"


def pack(folder: str, archive: str) -> int:
    """Writes every file of folder into a deflated ZIP; returns how many."""
    if not os.path.isdir(folder):
        raise InvalidContainer(f"{folder} is no folder")
    n = 0
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for base, dirs, names in os.walk(folder):
            dirs.sort()
            for name in sorted(names):
                full = os.path.join(base, name)
                if not name.endswith(".crc"):
                    z.write(full, os.path.relpath(full, folder))
                    n += 1
    return n


def unpack(archive: str, folder: str) -> int:
    """Extracts an archive; a member that would land outside of folder is refused before anything is written."""
    try:
        with zipfile.ZipFile(archive) as z:
            base = os.path.realpath(folder)
            for m in z.infolist():
                to = os.path.realpath(os.path.join(base, m.filename))
                if to != base and not to.startswith(base + os.sep):
                    raise InvalidContainer(f"{m.filename} would leave {folder}")
            z.extractall(folder)
            return sum(not m.is_dir() for m in z.infolist())
    except zipfile.BadZipFile as e:
        raise InvalidContainer(f"{archive} is no archive") from e


class Container:
    """A store as a folder or as an archive."""

    def __init__(self, path: str):
        self.path = str(path)
        self.is_folder, self.is_zip = os.path.isdir(self.path), os.path.isfile(self.path) and zipfile.is_zipfile(self.path)
        if not (self.is_folder or self.is_zip):
            raise InvalidContainer(f"{path} is neither a folder nor an archive")

    @property
    def is_writable(self) -> bool:
        return self.is_folder

    def names(self) -> list[str]:
        if self.is_zip:
            with zipfile.ZipFile(self.path) as z:
                return sorted(m.filename for m in z.infolist() if not m.is_dir())
        return sorted(os.path.relpath(os.path.join(b, n), self.path) for b, _, names in os.walk(self.path) for n in names)

    def list_collections(self) -> list[str]:
        return sorted({p[1] for n in self.names() if len(p := n.replace(os.sep, "/").split("/")) > 2 and p[0] == "collections"})

    def exists(self, name: str) -> bool:
        return name in self.names()

    def read(self, name: str) -> bytes:
        if self.is_zip:
            with zipfile.ZipFile(self.path) as z:
                return z.read(name)
        with open(os.path.join(self.path, name), "rb") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        if not self.is_writable:
            raise InvalidContainer("an archive can't be written to")
        full = os.path.join(self.path, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(data)

    def folder(self, cache: str | None = None) -> str:
        """A folder with the store: itself, or the archive's content extracted into cache (a new folder unless given)."""
        if self.is_folder:
            return self.path
        to = cache or tempfile.mkdtemp(prefix="quillstone-")
        unpack(self.path, to)
        return to


def remove(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)
