"""JSON documents, digests and published folders on the driver, and contracts that name what a run was made from."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

BLOCK = 1 << 20


def load_json(path: str | Path) -> dict:
    """[S17] A JSON object; anything else is an error."""
    found = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a JSON object")
    return found


def write_json(path: str | Path, value: dict) -> None:
    """[K02] With sorted keys, put in place whole."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True) + "\n")
    os.replace(f.name, path)


def file_digest(path: str | Path) -> str:
    """SHA-256 of a file."""
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            found.update(block)
    return found.hexdigest()


def folder_digest(path: str | Path) -> str:
    """SHA-256 over all files in order of their relative names: each name's length in eight bytes, the name, the file's
    digest. A folder that is empty or not there is an error."""
    files = sorted(p for p in Path(path).rglob("*") if p.is_file())
    if not files:
        raise ValueError(f"no files in {path}")
    found = hashlib.sha256()
    for p in files:
        name = p.relative_to(path).as_posix().encode()
        found.update(len(name).to_bytes(8, "big") + name + bytes.fromhex(file_digest(p)))
    return found.hexdigest()


def value_digest(value) -> str:
    """SHA-256 of a value's JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def published(path: str | Path, fill: Callable[[Path], None], force: bool = False) -> Path:
    """[K07, K09, K10] A folder that fill() fills under another name and that then takes its place, so that no reader sees half of
    it. One that is there already stays, and is an error, unless force is given."""
    path = Path(path)
    if path.exists() and not force:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    made = Path(tempfile.mkdtemp(dir=path.parent, prefix=f".{path.name}-"))
    try:
        fill(made)
        if path.exists():
            shutil.rmtree(path)
        os.replace(made, path)
    finally:
        shutil.rmtree(made, ignore_errors=True)
    return path


def contract(name: str, settings: dict, inputs: dict[str, str | Path]) -> dict:
    """[M54, M55] Settings and the digests of input files or folders, with a digest of all that."""
    own = {"contract": name, "settings": settings, "inputs": {k: {"path": str(p), "sha256": folder_digest(p) if Path(p).is_dir() else file_digest(p)} for k, p in sorted(inputs.items())}}
    return own | {"contract_sha256": value_digest(own)}


def check_contract(found: dict) -> dict:
    """[M56, M59] The contract, or an error: it was changed, or one of its inputs was."""
    own = {k: v for k, v in found.items() if k != "contract_sha256"}
    if value_digest(own) != found.get("contract_sha256"):
        raise ValueError("contract was changed")
    for k, x in own["inputs"].items():
        if (folder_digest if Path(x["path"]).is_dir() else file_digest)(x["path"]) != x["sha256"]:
            raise ValueError(f"input {k} was changed: {x['path']}")
    return found


def is_complete(folder: str | Path, wanted: dict) -> bool:
    """[M56] Whether a published folder was made by this very contract."""
    at = Path(folder) / "contract.json"
    return at.exists() and load_json(at).get("contract_sha256") == wanted["contract_sha256"]


def inspected(tables: dict[str, DataFrame]) -> list[dict]:
    """[S30] Name, columns and rows of each table."""
    return [{"table": n, "columns": df.columns, "rows": df.count()} for n, df in sorted(tables.items())]
