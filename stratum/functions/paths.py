"""Path predicates and classes: which files are left out, what language and diff budget they have."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists as they are.
CODE_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp",
    ".cs", ".rb", ".swift", ".kt", ".kts", ".scala", ".ex", ".exs", ".vue", ".svelte",
]
SCRIPT_EXTENSIONS = [".sql", ".graphql", ".gql", ".proto", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd", ".lua", ".r", ".m"]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".bmp", ".mp4", ".mp3", ".wav", ".ogg", ".webm", ".mov", ".avi",
    ".woff", ".woff2", ".ttf", ".eot", ".otf", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".wasm", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".lock",
]
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", "Cargo.lock", "poetry.lock", "Pipfile.lock"]
SENSITIVE = r"(?i)(\.env(\..+)?$|\.secret|\.pem$|\.key$|\.crt$|\.p12$|\.pfx$|id_rsa|id_ed25519)"
GENERATED_DIRS = [
    ".git/", "node_modules/", "dist/", "build/", ".next/", ".nuxt/", ".output/", "__pycache__/", ".pytest_cache/",
    "coverage/", ".nyc_output/", ".turbo/", ".cache/",
]
#: This engine's own folder, by default, within a repository.
STORE_DIR = ".stratum/"
DIFF_BUDGETS = {"code": 3000, "script": 1500, "other": 600}
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp",
    ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".ex": "elixir", ".exs": "elixir",
    ".vue": "vue", ".svelte": "svelte", ".sql": "sql", ".graphql": "graphql", ".gql": "graphql", ".proto": "protobuf",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".ps1": "powershell", ".lua": "lua", ".r": "r", ".m": "matlab",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml", ".html": "html", ".css": "css", ".scss": "scss",
    ".md": "markdown", ".txt": "text",
}
#: Languages whose symbols are extracted.
PARSED = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp",
}
DOC_NAME = r"(?i)^(readme|contributing|architecture|changelog|history|authors|license|code.of.conduct)"
OVERVIEW_PATH = r"(?i)readme|package\.json|index\.[tj]sx?$|app\.[tj]sx?$|main\.[tj]sx?$|\.md$"


def extension(path: Column) -> Column:
    """The lower-cased suffix from the last dot on, wherever that dot is; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column, root: str = ".") -> Column:
    """What stands before the last slash; ``root`` if there is none or nothing before it."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", root).otherwise(found)


def excluded(path: Column, sources: bool = False) -> Column:
    """Binary, lock and secret files; with ``sources`` also what lies in generated folders at any depth."""
    out = extension(path).isin(BINARY_EXTENSIONS) | basename(path).isin(LOCK_FILES) | path.rlike(SENSITIVE)
    if sources:
        out = out | reduce(or_, (path.startswith(d) | path.contains("/" + d) for d in [STORE_DIR, *GENERATED_DIRS]))
    return out


def diff_budget(path: Column) -> Column:
    """Characters that the diff of a file may keep."""
    ext = extension(path)
    return F.when(ext.isin(CODE_EXTENSIONS), DIFF_BUDGETS["code"]).when(ext.isin(SCRIPT_EXTENSIONS), DIFF_BUDGETS["script"]).otherwise(DIFF_BUDGETS["other"])


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def language(path: Column) -> Column:
    return F.coalesce(lookup(LANGUAGES, extension(path)), F.lit("unknown"))


def is_document(path: Column) -> Column:
    """Readmes and their like, by the name without its last suffix."""
    return F.regexp_replace(basename(path), r"\.[^.]+$", "").rlike(DOC_NAME)


def is_safe(path: Column) -> Column:
    """Relative, without a way up."""
    return ~path.startswith("/") & ~path.contains("..")


def normalized(path: Column) -> Column:
    """Without empty and dot segments, two dots taking one segment back."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))
