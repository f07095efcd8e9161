"""Repository path features: depth, extension, class flags, unwanted test
(P-5, P-16, P-17, F-5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# Fixed values that must equal the reference rules.
SOURCE_EXTENSIONS = [
    ".js", ".jsx", ".ts", ".tsx", ".vue", ".svelte",
    ".py", ".java", ".cpp", ".c", ".h", ".hpp",
    ".cs", ".php", ".rb", ".go", ".rs", ".swift",
    ".kt", ".scala", ".clj", ".hs", ".elm", ".dart",
    ".ipynb",
]
CONFIG_EXTENSIONS = [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".env"]
CONFIG_FILES = [
    "package.json", "tsconfig.json", "webpack.config.js", "babel.config.js",
    "eslintrc.js", ".eslintrc.json", "prettier.config.js", ".prettierrc",
    "jest.config.js", "vite.config.js", "next.config.js", "tailwind.config.js",
    "dockerfile", "docker-compose.yml", ".gitignore", "readme.md", "license",
]
# anchored at the start of the lower-case path (re.match semantics)
TEST_PATTERNS = [r".*test.*", r".*spec.*", r"__tests__", r"tests?/", r".*\.test\.",
                 r".*\.spec\.", r"cypress/", r"e2e/", r"integration/"]
DOCS_PATTERNS = [r"docs?/", r"documentation/", r"readme", r".*\.md$", r".*\.rst$",
                 r".*\.txt$", r"changelog", r"contributing", r"license"]
# unwanted when the lower-case path contains one of these
UNWANTED_DIR_PATTERNS = [
    "node_modules/", ".git/", ".vscode/", ".idea/", "__pycache__/",
    "dist/", "build/", "out/", ".next/", ".nuxt/", "coverage/",
    ".cache/", "tmp/", "temp/", ".tmp/", ".temp/", "logs/",
    "extensions/", "plugins/", "addons/", "modules/",
    ".github/", ".vscode/extensions/", "chrome-extension/",
    "browser-extension/", "vscode-extension/",
]
# unwanted when the lower-case file name contains one of these
UNWANTED_NAME_PATTERNS = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "requirements.txt", "pipfile.lock", "poetry.lock",
    "composer.lock", "gemfile.lock", "cargo.lock",
    ".gitignore", ".gitattributes", ".dockerignore", ".eslintignore",
    ".prettierignore", ".editorconfig", ".env.example", ".env.local",
    "dockerfile", "docker-compose.yml", "makefile", "rakefile",
    ".min.js", ".min.css", ".bundle.js", ".chunk.js",
    ".generated.", ".auto.", ".compiled.",
]
# recognised directory layouts (case-sensitive substring of a path)
LAYOUT_PATTERNS = ["components/", "pages/", "hooks/", "utils/", "services/",
                   "styles/", "assets/", "public/", "src/"]


def _parts(path: Column) -> Column:
    """``pathlib`` parts of a relative path: empty and '.' components vanish."""
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def file_name(path: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_parts(col_(path)), F.lit(-1)), F.lit(""))


def path_depth(path: Column | str) -> Column:
    p = col_(path)
    return (F.size(_parts(p)) - 1 + F.when(p.startswith("/"), 1).otherwise(0)).cast("int")


def name_suffix(name: Column) -> Column:
    """``Path.suffix``: last '.xxx' of the name, '' for dot-files / trailing dot."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def path_extension(path: Column | str, type_: Column | str) -> Column:
    """Lower-case suffix for blobs, null for other entries."""
    return F.when(col_(type_) == "blob", F.lower(name_suffix(file_name(path))))


def _any_match(c: Column, patterns) -> Column:
    # re.match anchors at the start only; DOTALL-free like Python's default
    return c.rlike("^(?:" + "|".join(patterns) + ")")


def is_source(ext: Column) -> Column:
    return F.coalesce(ext.isin(SOURCE_EXTENSIONS), F.lit(False))


def is_config(path: Column | str, ext: Column) -> Column:
    lp = F.lower(col_(path))
    name = F.lower(file_name(path))
    return (F.coalesce(ext.isin(CONFIG_EXTENSIONS), F.lit(False)) | name.isin(CONFIG_FILES)
            | lp.contains("config") | lp.contains("settings"))


def is_test(path: Column | str) -> Column:
    return _any_match(F.lower(col_(path)), TEST_PATTERNS)


def is_docs(path: Column | str) -> Column:
    lp = F.lower(col_(path))
    # '$' in Python also matches before one trailing newline
    return _any_match(lp, [p.replace("$", r"\n?\z") for p in DOCS_PATTERNS])


def _literal_alternation(words) -> str:
    import re
    return "|".join(re.escape(w) for w in words)


def is_unwanted(path: Column | str) -> Column:
    """F-5: any unwanted directory pattern in the lower path, or any unwanted
    name pattern in the lower file name (one regex scan each)."""
    lp = F.lower(col_(path))
    name = F.lower(file_name(path))
    return lp.rlike(_literal_alternation(UNWANTED_DIR_PATTERNS)) | name.rlike(_literal_alternation(UNWANTED_NAME_PATTERNS))


def repo_url_parts(url: Column | str) -> tuple[Column, Column, Column]:
    """P-5: (owner, repo, error) from a repository URL's path."""
    u = col_(url)
    path = F.regexp_extract(u, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    parts = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")
    ok = F.size(parts) >= 2
    owner = F.when(ok, F.get(parts, 0))
    repo = F.when(ok, F.get(parts, 1))
    err = F.when(~ok, F.concat(F.lit("Invalid GitHub URL format: "), u))
    return owner, repo, err
