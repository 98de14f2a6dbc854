"""Texts, names, numbers and patterns the output format prescribes."""

# Markdown texts of a document
TITLE = "# Directory Documentation: "
STRUCTURE_HEADING = "## Structure\n\n"
CONTENTS_HEADING = "\n## Contents\n\n"
TREE_FENCE = "```\n"
FILE_HEADING = "### 📄 "
FILE_MARKER = "### 📄"
SECTION_MARKER = "## "
DIR_ICON = "📁"
FILE_ICON = "📄"
TREE_BRANCH = "├── "
TREE_INDENT = "│   "
BINARY_NOTE = "*Binary file*\n"
ERROR_NOTE = "*Error reading file*\n"
SIZE_NOTE = "- Size: "
SUMMARY_INTRO = (
    "# Documentation Summary\n\n"
    "The output is a Markdown document summarizing a directory’s structure and file "
    "contents. It begins with token and size statistics, followed by a hierarchical view "
    "of the directory layout. For each file (unless omitted in structure-only mode), its "
    "contents are included in fenced code blocks with optional language annotations and "
    "metadata like file size, forming a complete, self-contained reference.\n\n"
)
SPLIT_NOTE = (
    "Note: This document has been split into multiple parts due to size limitations.\n\n"
)
TOKEN_SIZE = "Token Size: "
CONTINUED_FROM = "---\n**Continued from part {}**\n\n"
CONTINUED_IN = "\n\n---\n**Continued in part {}**\n"

# File names
IGNORE_FILE = ".gitignore"
VCS_DIR = ".git"
OUTPUT_SUFFIX = "_documentation.md"
OUTPUT_FALLBACK = "directory"

# Extension (lower case) -> fence language
LANGUAGES = {
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "hpp": "cpp",
    "md": "markdown",
    "sql": "sql",
    "sh": "bash",
    "py": "python",
    "js": "javascript",
    "json": "json",
    "html": "html",
}
MAKE_NAMES = ("makefile", "gnumakefile")
MAKE_LANGUAGE = "make"
BINARY_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "ico")

# Binary detection
SNIFF_BYTES = 1024
PRINTABLE_RATIO = 0.85
PRINTABLE_CLASS = r"\x09\x0A\x0D\x20-\x7E"

# Sizes
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
MEGABYTE = 1024 * 1024

# Token counting
TOKENS_PER_WORD = 1.3
UNCOUNTED_BYTE = "!"
SPECIAL_TOKENS = {
    "<|endoftext|>": 100257,
    "<|fim_prefix|>": 100258,
    "<|fim_middle|>": 100259,
    "<|fim_suffix|>": 100260,
    "<|endofprompt|>": 100276,
}

# Splitting
DEFAULT_LIMIT_MB = 18.0
MAX_SPLITS = 100
NEWLINE_WINDOW = 200

# Lint: a function definition that starts in column 0, on one line
FUNCTION_LINE = r"^[A-Za-z_][A-Za-z0-9_ \t\n\x0B\f\r*]*\([^;]*\)[ \t\n\x0B\f\r]*\{"
NOT_A_FUNCTION = r"^(struct|enum|class) "
