"""Options of a packing run."""

from __future__ import annotations

from dataclasses import dataclass

from corpuspack import fixed

OVERSIZE_POLICIES = ("keep", "split", "structure_only", "drop")
TOKEN_MODES = ("approx", "bytes", "vocab")


@dataclass(frozen=True)
class PackOptions:
    """What to include, how to count, and when to split.

    ``block_bytes`` bounds the size of one row of assembled text; documents and
    parts larger than that become several rows, in order. ``max_splits`` (no bound
    by default; the format's own is ``fixed.MAX_SPLITS``) leaves the rest to the last
    part. ``token_mode`` is ``vocab`` where a vocabulary is given, else ``approx``.
    """

    extra_patterns: tuple[str, ...] = ()
    use_ignore_files: bool = True
    include_vcs: bool = False
    structure_only: bool = False
    split: bool = False
    limit_mb: float = fixed.DEFAULT_LIMIT_MB
    max_splits: int | None = None
    on_oversize: str = "keep"
    token_mode: str | None = None
    block_bytes: int = 64 * fixed.MEGABYTE

    def __post_init__(self) -> None:
        if self.on_oversize not in OVERSIZE_POLICIES:
            raise ValueError(f"on_oversize must be one of {OVERSIZE_POLICIES}")
        if self.token_mode is not None and self.token_mode not in TOKEN_MODES:
            raise ValueError(f"token_mode must be one of {TOKEN_MODES}")
        if self.block_bytes < 1 or (self.max_splits is not None and self.max_splits < 0):
            raise ValueError("block_bytes must be positive and max_splits not negative")

    @property
    def limit_bytes(self) -> int:
        """Part limit in bytes, cut to a whole byte; the default where not positive."""
        megabytes = self.limit_mb if self.limit_mb > 0 else fixed.DEFAULT_LIMIT_MB
        return int(megabytes * fixed.MEGABYTE)
