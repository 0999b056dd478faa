"""The property graph: node and edge kinds, schemas, identifiers."""

from __future__ import annotations

NODE_KINDS = ("repository", "file", "module", "symbol", "external")
SEMANTIC, STRUCTURAL = ("calls", "imports", "depends_on"), ("contains", "defines")
#: Edge weights, walk decay and default entry points.
WEIGHTS = {"calls": "1.00", "depends_on": "0.85", "imports": "0.70", "defines": "0.35", "contains": "0.25"}
OTHER_WEIGHT, DECAY = "0.50", "0.75"
ENTRY_NAMES = ("Main", "main", "Startup", "Program", "ConfigureServices", "Configure")

NODES = "id string, kind string, name string, language string, file_path string, source_hash string, signature string, metadata map<string,string>"
EDGES = "type string, src string, dst string, file_path string, line int, metadata map<string,string>"


def slashed(path: str) -> str:
    return path.replace("\\", "/")


def repo_id(path: str) -> str:
    return f"repo:{slashed(path)}"


def file_id(path: str) -> str:
    return f"file:{slashed(path)}"


def symbol_id(path: str, name: str, position: int) -> str:
    return f"symbol:{slashed(path)}#{name}@{position}"


def module_id(name: str) -> str:
    return f"module:{name}"


def external_id(name: str) -> str:
    return f"external:{name}"


def allowed(structural: bool) -> tuple[str, ...]:
    return (*SEMANTIC, *STRUCTURAL) if structural else SEMANTIC


def clamp(raw: object, low: int, high: int, default: int) -> int:
    """Truncated toward zero and bounded; what is no finite number gives the default."""
    try:
        value = float(raw)  # type: ignore[arg-type]
        return max(low, min(high, int(value)))
    except (TypeError, ValueError, OverflowError):
        return default
