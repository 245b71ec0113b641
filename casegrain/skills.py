"""Analysers from folders: a manifest (skill.json, skill.yaml or skill.yml) and a Python file beside it.

The entry point names a function from a case's tables to findings. A skill that can't be loaded is reported, and the others load.
"""

from __future__ import annotations

import importlib.util
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.plans import casework


@dataclass
class Manifest:
    name: str
    tier: int = 6
    version: str = "1.0.0"
    description: str = ""
    formats: list[str] = field(default_factory=lambda: ["*"])
    entry_point: str = "skill.py:analyse"


def _scalar(text: str):
    text = text.strip().strip("\"'")
    if text.startswith("[") and text.endswith("]"):
        return [t.strip().strip("\"'") for t in text[1:-1].split(",") if t.strip()]
    return int(text) if text.isdigit() else {"true": True, "false": False}.get(text.lower(), text)


def read_manifest(path: Path) -> Manifest:
    """JSON, or plain lines of ``key: value``."""
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        data = json.loads(text)
    else:
        pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#"))
        data = {k.strip(): _scalar(v) for k, v in pairs}
    return Manifest(str(data.get("name", path.parent.name)), int(data.get("target_tier", 6)), str(data.get("version", "1.0.0")), str(data.get("description", "")), list(data.get("supported_formats", ["*"])), str(data.get("entry_point", "skill.py:analyse")))


def load(folder: Path) -> Manifest:
    """Registers the skill of a folder; its file must lie in the folder."""
    found = next((p for n in ("skill.yaml", "skill.yml", "skill.json") if (p := folder / n).exists()), None)
    if found is None:
        raise FileNotFoundError(f"no manifest in {folder}")
    manifest = read_manifest(found)
    file, _, function = manifest.entry_point.partition(":")
    path = (folder / file).resolve()
    if not path.is_relative_to(folder.resolve()) or path.suffix != ".py":
        raise ValueError(f"{manifest.entry_point} leaves the skill's folder")
    spec = importlib.util.spec_from_file_location(f"casegrain_skill_{manifest.name}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    analyse = getattr(module, function or "analyse")

    def only_its_formats(case: dict[str, DataFrame]) -> DataFrame:
        if "*" in manifest.formats:
            return analyse(case)
        own = case["files"].where(F.col("format").isin(manifest.formats))
        return analyse(case | {"files": own}).join(own.select("sha256").distinct(), "sha256", "left_semi")

    casework.register(manifest.name, manifest.tier, only_its_formats)
    return manifest


def discover(folders: list[str | Path]) -> tuple[list[Manifest], list[str]]:
    """(loaded skills, what went wrong) of all folders inside the given ones."""
    loaded, wrong = [], []
    for base in map(Path, folders):
        for folder in sorted(p for p in base.iterdir() if p.is_dir()) if base.is_dir() else ():
            try:
                loaded.append(load(folder))
            except Exception as e:
                wrong.append(f"{folder.name}: {e}")
    return loaded, wrong
