"""Languages by file extension."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of each extension.
EXTENSIONS = {
    ".py": "python", ".pyw": "python", ".swift": "swift", ".rs": "rust", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".hpp": "cpp", ".hxx": "cpp", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala",
    ".sc": "scala", ".lua": "lua", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
}


def detect_language(path: str) -> str | None:
    return EXTENSIONS.get(os.path.splitext(path)[1].lower())


def extensions_for(language: str | None = None) -> set[str]:
    """Extensions that are scanned: all, or those of one language (none for an unknown one; ``.h`` is scanned for cpp too)."""
    if language is None:
        return set(EXTENSIONS)
    return {e for e, k in EXTENSIONS.items() if k == language} | ({".h"} if language == "cpp" else set())


def language_of(path: Column) -> Column:
    """Language of a path, null if unknown."""
    pairs = [F.lit(x) for e in EXTENSIONS.items() for x in e]
    return F.get(F.map_values(F.map_filter(F.create_map(*pairs), lambda k, _: k == F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))), F.lit(0))
