"""Run configuration of a comparison run (the arguments of the reference job)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

# Fixed values that must equal the reference's for identical results:
# quantile levels of the RelDS summary and the regression threshold on relds_95,
# client-sample cut-offs compared as strings, and the RelDS zero-bin penalty.
RELDS_QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
CLIENT_MEAN_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
REGRESSION_THRESHOLD = 0.10
SAMPLE_NIGHTLY = "70"
SAMPLE_OTHER = "25"
SAMPLE_DEBUG = "42"
ZERO_VAL = 0.10
DEFAULT_WINDOW_DAYS = 28


@dataclass(frozen=True)
class RunConfig:
    """Arguments of one comparison run.

    probes        histogram columns of the ping table, in output order
    final_date    run date; the build window is [final_date - num_days, final_date]
    num_days      days recomputed per run (7 in the daily job)
    num_reps      Poisson bootstrap replicates (1000 in the daily job)
    seed          mixed into the hash of every weight; 0 keeps the hashed text short
    app, channel  constant equality predicates on the ping table (app is required)
    sample        'all' clients, or the cut sample: 'lexical' (string compare, as written)
                  or 'numeric'
    sample_cut    sample ids below this value are kept (None: the channel's usual cut)
    debug         restrict to one sample id
    estimator     add 0.5 to every present bin before normalising
    measured_rep  replicate reported as "measured" (0 = all profiles with weight 1)
    zero_val      RelDS penalty for a control bin of probability 0 that the test has
    uniform       'md5' (portable to SQL engines) or 'xxhash64' (fast)
    inclusive_end compare the day prefix with the upper bound instead of the raw id
    partitions    fixed task count of the profile stage (None: sized by AQE)
    rep_block     replicates expanded together: each block of them reads the profile
                  table and aggregates by itself, so this bounds a task's hash map
    """

    probes: tuple[str, ...]
    final_date: dt.date
    app: str
    num_days: int = 7
    num_reps: int = 1000
    seed: int = 0
    channel: str = "nightly"
    sample: str = "all"
    sample_cut: str | None = None
    debug: bool = False
    estimator: bool = False
    measured_rep: int = 0
    zero_val: float = ZERO_VAL
    uniform: str = "md5"
    inclusive_end: bool = False
    quantiles: tuple[float, ...] = field(default=RELDS_QUANTILES)
    partitions: int | None = None
    rep_block: int = 64

    def __post_init__(self):
        if not self.probes:
            raise ValueError("at least one probe is required")
        if len(set(self.probes)) != len(self.probes):
            raise ValueError("probes must be distinct")
        if self.num_reps < 1:
            raise ValueError("num_reps must be >= 1")
        if not 0 <= self.measured_rep <= self.num_reps:
            raise ValueError("measured_rep must lie in [0, num_reps]")
        if self.sample not in ("all", "lexical", "numeric"):
            raise ValueError("sample must be 'all', 'lexical' or 'numeric'")
        if self.rep_block < 1:
            raise ValueError("rep_block must be >= 1")
        if self.uniform not in ("md5", "xxhash64"):
            raise ValueError("uniform must be 'md5' or 'xxhash64'")

    def with_(self, **kw) -> "RunConfig":
        return replace(self, **kw)

    @property
    def cut(self) -> str:
        if self.debug:
            return SAMPLE_DEBUG
        if self.sample_cut is not None:
            return self.sample_cut
        return SAMPLE_NIGHTLY if self.channel == "nightly" else SAMPLE_OTHER
