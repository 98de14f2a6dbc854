"""Parameters of the registered queries."""

from corpuspack import fixed

# Small limits, so that the test tables give several parts and blocks per repository.
LIMIT_MB = 0.02
LIMIT_BYTES = int(LIMIT_MB * fixed.MEGABYTE)
MAX_SPLITS = fixed.MAX_SPLITS
SMALL_MAX_SPLITS = 2
BLOCK_BYTES = 64 * 1024
SMALL_BLOCK = 1024  # several blocks for a document's structure
SMALL_CHUNK = 500  # bytes of a file
OVERSIZE_MB = 0.06
OVERSIZE_BYTES = int(OVERSIZE_MB * fixed.MEGABYTE)

# Patterns of a caller, after those of the ignore files.
EXTRA_PATTERNS = ("*.json", "!/src/", "docs/fr/", "d?.md", "lib**.c", "/d1*")

# Ids of special tokens made from the roles of conversations come after this.
SPECIAL_ID = 1_000_000
