"""Fixed values as the oracle SQL has them, stated apart from the code under test."""

TOPICAL_KEYWORDS = [
    "edu", "university", "college", "academic", "research", "math", "mathematics", "science", "physics",
    "chemistry", "biology", "engineering", "mit", "stanford", "harvard", "arxiv", "scholar", "journal",
    "publication", "institute", "lab", "department", "faculty", "course", "lecture",
]

BANNER_START = "/*" + 93 * "-"

CODE_EXTENSIONS_BONUS = [
    "ts", "tsx", "js", "jsx", "py", "rs", "go",
]

CODE_LINE_WORDS = [
    "function", "class", "interface", "def",
]

CODE_STRUCTURE_WORDS = [
    "function", "class", "interface", "import", "export",
]

CODE_TECH_KEYWORDS = [
    "react", "typescript", "javascript", "python", "component", "function", "method", "api",
]

CONFIG_EXTENSIONS = [
    ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".env",
]

CONFIG_FILES = [
    "package.json", "tsconfig.json", "webpack.config.js", "babel.config.js", "eslintrc.js", ".eslintrc.json",
    "prettier.config.js", ".prettierrc", "jest.config.js", "vite.config.js", "next.config.js",
    "tailwind.config.js", "dockerfile", "docker-compose.yml", ".gitignore", "readme.md", "license",
]

DOCS_PATTERNS = [
    "docs?/", "documentation/", "readme", ".*\\.md$", ".*\\.rst$", ".*\\.txt$", "changelog", "contributing",
    "license",
]

LAYOUT_PATTERNS = [
    "components/", "pages/", "hooks/", "utils/", "services/", "styles/", "assets/", "public/", "src/",
]

SOURCE_EXTENSIONS = [
    ".js", ".jsx", ".ts", ".tsx", ".vue", ".svelte", ".py", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".php",
    ".rb", ".go", ".rs", ".swift", ".kt", ".scala", ".clj", ".hs", ".elm", ".dart", ".ipynb",
]

TEST_PATTERNS = [
    ".*test.*", ".*spec.*", "__tests__", "tests?/", ".*\\.test\\.", ".*\\.spec\\.", "cypress/", "e2e/",
    "integration/",
]

UNWANTED_DIR_PATTERNS = [
    "node_modules/", ".git/", ".vscode/", ".idea/", "__pycache__/", "dist/", "build/", "out/", ".next/",
    ".nuxt/", "coverage/", ".cache/", "tmp/", "temp/", ".tmp/", ".temp/", "logs/", "extensions/", "plugins/",
    "addons/", "modules/", ".github/", ".vscode/extensions/", "chrome-extension/", "browser-extension/",
    "vscode-extension/",
]

UNWANTED_NAME_PATTERNS = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "pipfile.lock", "poetry.lock",
    "composer.lock", "gemfile.lock", "cargo.lock", ".gitignore", ".gitattributes", ".dockerignore",
    ".eslintignore", ".prettierignore", ".editorconfig", ".env.example", ".env.local", "dockerfile",
    "docker-compose.yml", "makefile", "rakefile", ".min.js", ".min.css", ".bundle.js", ".chunk.js",
    ".generated.", ".auto.", ".compiled.",
]

DIMENSIONS = [
    "relevance", "accuracy", "completeness", "clarity", "specificity",
]

SCORE_KEYS = [
    "RELEVANCE", "ACCURACY", "COMPLETENESS", "CLARITY", "SPECIFICITY", "OVERALL", "REASON",
]
