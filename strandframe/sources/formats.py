"""Which format and compression a path has, and what an output inherits from its input."""

from __future__ import annotations

import os
from dataclasses import dataclass

#: Extensions of formats and of compressions.
EXTENSIONS = {"fasta": "fasta", "fa": "fasta", "fna": "fasta", "fastq": "fastq", "fq": "fastq", "csv": "csv", "tsv": "tsv", "txt": "tsv", "qual": "qual"}
COMPRESSION = {"gz": "gz", "gzip": "gz", "bz2": "bz2", "bzip2": "bz2", "lz4": "lz4", "zst": "zstd", "zstd": "zstd"}
DEFAULT = "fasta"
#: The variable of the environment that names a format where none is given.
ENVIRONMENT = "STRANDFRAME_FORMAT"


@dataclass(frozen=True)
class Format:
    name: str = DEFAULT
    compression: str | None = None
    quality: str = "sanger"

    @property
    def delimiter(self) -> str | None:
        return {"csv": ",", "tsv": "\t"}.get(self.name)


def of_name(name: str) -> Format:
    """A format by its name, with a quality variant and a compression: fq-illumina, tsv.gz."""
    base, _, compression = name.lower().partition(".")
    base, _, variant = base.partition("-")
    if base not in EXTENSIONS or (compression and compression not in COMPRESSION):
        raise ValueError(f"unknown format: {name!r}")
    if variant not in ("", "sanger", "illumina", "solexa"):
        raise ValueError(f"unknown quality format: {variant!r}")
    return Format(EXTENSIONS[base], COMPRESSION.get(compression), variant or "sanger")


def of_path(path: str) -> Format | None:
    parts = os.path.basename(path).lower().split(".")
    compression = COMPRESSION.get(parts[-1]) if len(parts) > 1 else None
    if compression:
        parts = parts[:-1]
    if len(parts) > 1 and parts[-1] in EXTENSIONS:
        return Format(EXTENSIONS[parts[-1]], compression)
    return Format(DEFAULT, compression) if compression else None


def resolve_input(path: str, given: str | None = None) -> Format:
    """An explicit format, else that of the environment, else by the extension, else FASTA."""
    by_path = of_path(path)
    name = given or os.environ.get(ENVIRONMENT)
    if name:
        f = of_name(name)
        return f if f.compression or not by_path else Format(f.name, by_path.compression, f.quality)
    return by_path or Format()


def resolve_output(path: str, source: Format, given: str | None = None) -> Format:
    if given:
        return of_name(given)
    return of_path(path) or Format(source.name, None, source.quality)
