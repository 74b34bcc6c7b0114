"""Settings of the mapping plan."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    """Defaults and checks of the mapper. max_hamming_ratio is a ratio of the read's length, not a percentage. bucket_mode all leaves out no read; truncate and drop cut buckets of more than max_results_per_map."""

    kmerlength: int = 16
    num_hash_functions: int = 16
    max_results_per_map: int = 65_535
    bucket_mode: str = "all"
    window_size: int = 128
    min_table_hits: int = 4
    max_hamming_ratio: float = 0.05
    mapper: str = "sw"
    min_mapq: int = 20
    seed_alphabet: str = "4N"

    def __post_init__(self) -> None:
        problems = [
            (1 <= self.kmerlength <= 32, "kmerlength must be 1 to 32"), (1 <= self.num_hash_functions <= 48, "num_hash_functions must be 1 to 48"),
            (self.num_hash_functions >= self.min_table_hits, "num_hash_functions must be at least min_table_hits"), (self.window_size >= self.kmerlength, "window_size must be at least kmerlength"),
            (self.mapper in ("sw", "edit"), "mapper must be sw or edit"), (self.bucket_mode in ("all", "truncate", "drop"), "bucket_mode must be all, truncate or drop"), (self.seed_alphabet in ("4N", "3N"), "seed_alphabet must be 4N or 3N"),
        ]
        for good, message in problems:
            if not good:
                raise ValueError(message)

    @classmethod
    def parse(cls, arguments: list[str]) -> tuple[Options, list[str]]:
        parser = argparse.ArgumentParser(prog="strandline")
        for f in fields(cls):
            parser.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
        known, rest = parser.parse_known_args(arguments)
        return cls(**vars(known)), rest
