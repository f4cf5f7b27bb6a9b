"""Remote stores: providers by URI scheme, a local cache, and loading by one call.

Git is cloned. Object stores (s3, gcs, azure) and http are addressed through the file systems that Spark is set up
with, so loading returns their URI; ftp and model hubs only parse.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from quillstone.errors import CollectionNotFound
from quillstone.store import Root

DEFAULT_SCHEME = "github"
CACHE_VARIABLE = "QUILLSTONE_CACHE"
# Hosts by short name.
HOSTS = {"github": "github.com", "gitlab": "gitlab.com", "bitbucket": "bitbucket.org", "codeberg": "codeberg.org"}


@dataclass
class DatasetInfo:
    name: str
    provider: str
    uri: str
    revision: str | None = None
    path: str | None = None
    size_bytes: int | None = None
    collections: tuple[str, ...] = ()


class Provider:
    """Parses the URIs of one kind of remote store and resolves them to a path that Spark can read."""

    name = "base"

    def parse(self, uri: str) -> dict[str, Any]:
        raise NotImplementedError

    def resolve(self, uri: str, cache: Path, revision: str | None = None, force: bool = False, token: str | None = None) -> str:
        raise NotImplementedError(f"{self.name} stores can't be loaded")


class GitProvider(Provider):
    """owner/repository[@revision], led by a host or not."""

    name = "git"
    _SHAPE = re.compile(r"^(?:([\w.-]+\.[\w-]+|[a-z]+)/)?([\w-]+)/([\w.-]+?)(?:\.git)?(?:@([\w./-]+))?$", re.A)

    def __init__(self, host: str = "github.com"):
        self.host = host

    def parse(self, uri: str) -> dict[str, Any]:
        m = self._SHAPE.match(uri)
        if not m or (m[1] and "." not in m[1] and m[1] not in HOSTS):
            raise ValueError(f"no repository in {uri!r}")
        return {"host": HOSTS.get(m[1], m[1]) if m[1] else self.host, "owner": m[2], "repo": m[3], "revision": m[4]}

    def resolve(self, uri: str, cache: Path, revision: str | None = None, force: bool = False, token: str | None = None) -> str:
        p = self.parse(uri)
        wanted = revision or p["revision"]
        to = cache / "git" / p["host"] / p["owner"] / p["repo"] / (wanted or "head").replace("/", "__")
        if force:
            shutil.rmtree(to, ignore_errors=True)
        if not to.exists():
            login = f"{token}@" if token else ""
            source = f"https://{login}{p['host']}/{p['owner']}/{p['repo']}.git"
            to.parent.mkdir(parents=True, exist_ok=True)
            subprocess.run(["git", "clone", "--quiet", source, str(to)], check=True, capture_output=True)
            if wanted:
                subprocess.run(["git", "-C", str(to), "checkout", "--quiet", wanted], check=True, capture_output=True)
        return str(to)


class BucketProvider(Provider):
    """bucket/key, read by Spark through a Hadoop file system."""

    def __init__(self, name: str, scheme: str):
        self.name, self.scheme = name, scheme

    def parse(self, uri: str) -> dict[str, Any]:
        bucket, _, key = uri.partition("/")
        if not bucket:
            raise ValueError(f"no bucket in {uri!r}")
        return {"bucket": bucket, "key": key.rstrip("/")}

    def resolve(self, uri: str, cache: Path, revision: str | None = None, force: bool = False, token: str | None = None) -> str:
        p = self.parse(uri)
        return f"{self.scheme}://{p['bucket']}/{p['key']}"


class AzureProvider(BucketProvider):
    """account/container/key."""

    def parse(self, uri: str) -> dict[str, Any]:
        parts = uri.split("/", 2)
        if len(parts) < 2 or not all(parts[:2]):
            raise ValueError(f"no account and container in {uri!r}")
        return {"account": parts[0], "container": parts[1], "key": parts[2].rstrip("/") if len(parts) > 2 else ""}

    def resolve(self, uri: str, cache: Path, revision: str | None = None, force: bool = False, token: str | None = None) -> str:
        p = self.parse(uri)
        return f"{self.scheme}://{p['container']}@{p['account']}.dfs.core.windows.net/{p['key']}"


class AddressProvider(Provider):
    """host/path; parses only."""

    def __init__(self, name: str):
        self.name = name

    def parse(self, uri: str) -> dict[str, Any]:
        host, _, path = uri.partition("/")
        if not host:
            raise ValueError(f"no host in {uri!r}")
        return {"host": host, "path": path}


class HubProvider(Provider):
    """owner/name[@revision]; parses only."""

    name = "huggingface"

    def parse(self, uri: str) -> dict[str, Any]:
        name, _, revision = uri.partition("@")
        if name.count("/") != 1 or not all(name.split("/")):
            raise ValueError(f"no owner/name in {uri!r}")
        return {"owner": name.split("/")[0], "name": name.split("/")[1], "revision": revision or None}


_providers: dict[str, Provider] = {}
_default = DEFAULT_SCHEME


def register_provider(scheme: str, provider: Provider) -> None:
    _providers[scheme.lower()] = provider


def provider(scheme: str) -> Provider:
    if scheme.lower() not in _providers:
        raise ValueError(f"unknown scheme {scheme!r}; there are {', '.join(sorted(_providers))}")
    return _providers[scheme.lower()]


def providers() -> dict[str, Provider]:
    return dict(_providers)


def set_default(scheme: str) -> None:
    global _default
    provider(scheme)
    _default = scheme.lower()


def parse_uri(uri: str) -> tuple[str, str]:
    """(scheme, rest); the default scheme where there is none."""
    scheme, sep, rest = uri.partition("://")
    return (scheme.lower(), rest) if sep else (_default, uri)


for _short, _host in HOSTS.items():
    register_provider(_short, GitProvider(_host))
register_provider("git", GitProvider())
for _name, _scheme in (("s3", "s3a"), ("gcs", "gs")):
    register_provider(_name, BucketProvider(_name, _scheme))
register_provider("gs", BucketProvider("gcs", "gs"))
register_provider("azure", AzureProvider("azure", "abfss"))
for _name in ("ftp", "http", "https"):
    register_provider(_name, AddressProvider(_name))
for _name in ("huggingface", "hf"):
    register_provider(_name, HubProvider())


def cache_dir() -> Path:
    found = Path(os.environ.get(CACHE_VARIABLE) or Path.home() / ".cache" / "quillstone")
    found.mkdir(parents=True, exist_ok=True)
    return found


def clear_cache(scheme: str | None = None) -> None:
    """Removes what was downloaded, of one provider or all."""
    shutil.rmtree(cache_dir() / scheme if scheme else cache_dir(), ignore_errors=True)


def locate(path: str, revision: str | None = None, subpath: str | None = None, force: bool = False, token: str | None = None) -> str:
    """The folder of a local or remote store."""
    if not os.path.exists(path):
        scheme, rest = parse_uri(path)
        path = provider(scheme).resolve(rest, cache_dir(), revision, force, token)
    return f"{path.rstrip('/')}/{subpath}" if subpath else path


def load_remote(spark: SparkSession, path: str, collection: str | None = None, split: str | None = None, streaming: bool = False, **options: Any) -> Any:
    """A dataset over a collection (also called a split) of a local or remote store; the first one unless named."""
    root = Root(spark, locate(path, **options), "r")
    name = collection or split or next(iter(root.list_collections()), None)
    if name is None:
        raise CollectionNotFound(f"no collection in {path}")
    found = root.collection(name)
    return found.iterable() if streaming else found.dataset()


def dataset_info(spark: SparkSession, path: str, **options: Any) -> DatasetInfo:
    where = locate(path, **options)
    root = Root(spark, where, "r")
    kind = "local" if os.path.exists(path) else parse_uri(path)[0]
    return DatasetInfo(os.path.basename(path.rstrip("/")), kind, path, options.get("revision"), where, root.files.size(where), tuple(root.list_collections()))


def list_remote_collections(spark: SparkSession, path: str, **options: Any) -> list[str]:
    return Root(spark, locate(path, **options), "r").list_collections()
