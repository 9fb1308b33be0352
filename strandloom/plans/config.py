"""Settings of the clustering pipeline."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Names and defaults are fixed values; settings of threads, folders and bit vectors are read and have no effect here."""

    input_reads: str = ""
    final_clusters_out: str = ""
    workspace: str = ""
    threads: int = 4
    read_filtering_k: int = 16
    read_filtering_threshold: int = 4
    preclustering_k: int = 36
    precluster_min_size: int = 80
    precluster_max_size: int = 10
    kmeans_kmer_length: int = 4
    run_metacluster: bool = False
    kmeans_number_of_clusters: int = 50
    kmeans_number_of_rounds: int = 100
    bitvector: str = "basic"
    paired_ends: bool = False
    only_kmeans: bool = False
    filtering_good_out: str = ""
    filtering_bad_out: str = ""
    preclusters_out: str = ""

    def with_values(self, pairs: Iterable[tuple[str, str]]) -> Config:
        kinds = {f.name: f.type for f in fields(self)}
        changes = {}
        for key, text in pairs:
            name = key.removeprefix("--").replace("-", "_")
            if name not in kinds:
                raise ValueError(f"unknown setting {key!r}")
            changes[name] = {"int": int, "bool": lambda x: {"true": True, "false": False}[x.lower()]}.get(kinds[name], str)(text)
        return replace(self, **changes)


def read_config(text: str) -> Config:
    """``key: value`` lines; ``#`` opens a comment; every setting must be there."""
    found = {}
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line:
            key, _, value = line.partition(":")
            found[key.strip()] = value.strip()
    missing = {f.name for f in fields(Config)} - {k.removeprefix("--").replace("-", "_") for k in found}
    if missing:
        raise ValueError(f"settings missing: {', '.join(sorted(missing))}")
    return Config().with_values(found.items())


def command_line(config: Config, args: list[str]) -> Config:
    """``--name value`` pairs over a config."""
    if len(args) % 2:
        raise ValueError("every setting needs a value")
    return config.with_values(zip(args[::2], args[1::2]))
