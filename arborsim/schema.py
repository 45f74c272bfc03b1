"""Schemas and fixed values of the file tree, the embedding index and the model."""

from __future__ import annotations

from dataclasses import dataclass

TREE = "path string, blob_sha string"
BLOBS = "path string, blob_sha string, content binary"
INDEX = "blob_sha string, vec array<float>"

VERSION = 1
MODEL = "nomic-embed-text-v1.5"
DIMS = 768

#: File name endings that mark text files.
TEXT_EXTENSIONS = (
    ".adoc", ".bash", ".bb", ".c", ".cfg", ".clj", ".cljc", ".cljs", ".cpp", ".cs", ".css", ".dhall", ".dockerfile", ".editorconfig", ".edn", ".el", ".ex", ".exs", ".fish",
    ".gitattributes", ".gitignore", ".go", ".graphql", ".h", ".hcl", ".hpp", ".hs", ".html", ".ini", ".java", ".js", ".json", ".jsx", ".kt", ".lisp", ".lua", ".md", ".ml",
    ".nix", ".org", ".proto", ".py", ".r", ".rb", ".rkt", ".rs", ".rst", ".scala", ".scm", ".sh", ".sql", ".swift", ".tex", ".tf", ".toml", ".ts", ".tsx", ".txt", ".vim",
    ".xml", ".yaml", ".yml", ".zsh",
)
MAX_BLOB_BYTES = 102_400
PREFIX_DOCUMENT, PREFIX_QUERY = "search_document: ", "search_query: "
CHUNK_TOKENS = 512


@dataclass(frozen=True)
class SearchOptions:
    dims: int = DIMS
    top: int = 10
    path: str | None = None


@dataclass(frozen=True)
class IndexMeta:
    version: int = VERSION
    model: str = MODEL
    dims: int = DIMS
