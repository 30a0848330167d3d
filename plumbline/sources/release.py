"""Release bundles: deterministic archives, checked reading, ordered migrations."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import tarfile
from collections.abc import Callable


def sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def manifest(folder: str) -> dict[str, str]:
    """Relative path and SHA-256 of every file, in order."""
    files = [os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names]
    return {f: sha256(os.path.join(folder, f)) for f in sorted(files)}


def fingerprint(folder: str) -> str:
    return hashlib.sha256(json.dumps(manifest(folder), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def package(folder: str, archive: str) -> str:
    """A tar.gz whose bytes depend on names and contents alone; returns its SHA-256."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name in manifest(folder):
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.mtime = os.path.getsize(os.path.join(folder, name)), 0o644, 0
            with open(os.path.join(folder, name), "rb") as f:
                tar.addfile(info, f)
    with open(archive, "wb") as f, gzip.GzipFile(filename="", fileobj=f, mode="wb", mtime=0) as z:
        z.write(raw.getvalue())
    return sha256(archive)


def unpack(archive: str, folder: str, expected: str, most_bytes: int = 1 << 32) -> None:
    """Extract a verified archive: its hash must match, members stay inside the folder, and the total is bounded."""
    if sha256(archive) != expected:
        raise ValueError("the archive is not the expected one")
    root, total = os.path.realpath(folder), 0
    with tarfile.open(archive, "r:gz") as tar:
        for m in tar:
            to = os.path.realpath(os.path.join(root, m.name))
            if not m.isfile() or not to.startswith(root + os.sep):
                raise ValueError(f"refused: {m.name}")
            total += m.size
            if total > most_bytes:
                raise ValueError("the archive is too large")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "wb") as f:
                f.write(tar.extractfile(m).read())


def read_release(spark, folder: str, expected: str, tables: dict[str, dict]) -> dict:
    """Tables of a release as DataFrames, after checks of its fingerprint, schemas, keys and references.

    tables: name -> {"schema": {column: type}, "key": [...], "refers": {column: (table, column)}}.
    """
    from pyspark.sql import functions as F

    from plumbline.operators.constraints import schema_drift
    from plumbline.operators.relational import duplicates, orphans

    if fingerprint(folder) != expected:
        raise ValueError("the release's fingerprint differs")
    out = {n: spark.read.parquet(os.path.join(folder, f"{n}.parquet")) for n in tables}
    for n, spec in tables.items():
        if drift := schema_drift(out[n], spec["schema"]):
            raise ValueError(f"{n}: {'; '.join(drift)}")
        if spec.get("key") and not duplicates(out[n], spec["key"]).isEmpty():
            raise ValueError(f"{n}: repeated keys")
        for c, (other, key) in spec.get("refers", {}).items():
            if not orphans(out[n].where(F.col(c).isNotNull()), out[other], c, key).isEmpty():
                raise ValueError(f"{n}.{c}: no such {other}")
    return out


def migrate(steps: list[tuple[str, str]], done: dict[str, str], execute: Callable[[str], None]) -> list[str]:
    """Run ordered SQL migrations that are not done; a done one whose text changed is an error. Returns what ran."""
    ran = []
    for name, sql in sorted(steps):
        check = hashlib.sha256(sql.encode()).hexdigest()
        if name in done:
            if done[name] != check:
                raise ValueError(f"{name} was changed after it ran")
            continue
        execute(sql)
        done[name] = check
        ran.append(name)
    return ran
