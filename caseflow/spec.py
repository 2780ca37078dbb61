"""Column roles of an event log and small value-level helpers."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Iterable, Optional, Sequence, Union

# Fixed values that must match the reference for identical results:
# special vocabulary entries and their ids, and the end-of-case label.
PAD = "<PAD>"
UNK = "<UNK>"
EOS = "<EOS>"
PAD_ID = 0
UNK_ID = 1
EOS_ID = 2
SPECIALS = (PAD, UNK, EOS)
MASKED_TARGET = -1
UNKNOWN_RESOURCE = "UNKNOWN"

# The ten numeric time features expanded by feature_set("all").
NUMERICAL_FEATURES = (
    "accumulated_time",
    "day_of_month",
    "day_of_week",
    "day_of_year",
    "hour_of_day",
    "min_of_hour",
    "month_of_year",
    "sec_of_min",
    "secs_within_day",
    "week_of_year",
)


@dataclass(frozen=True)
class LogSpec:
    """Names of the columns that play each role in an event log.

    ``order`` lists extra columns that make the order of events inside a case
    total (timestamp ties are broken by them).  Spark has no stable source
    order, so an adapter must supply them.
    """

    case: str = "case_id"
    activity: str = "activity"
    ts: str = "ts"
    order: tuple = ("seq",)
    resource: Optional[str] = None
    lifecycle: Optional[str] = None
    amount: Optional[str] = None

    @property
    def order_by(self) -> list:
        """Full within-case order: timestamp then the tie-break columns."""
        return [self.ts, *self.order]

    @property
    def optional(self) -> list:
        return [c for c in (self.resource, self.lifecycle, self.amount) if c]

    def with_(self, **kw) -> "LogSpec":
        return replace(self, **kw)


def as_list(value: Union[None, str, Iterable[str]]) -> list:
    """None -> [], str -> [str], list/tuple -> list; anything else is an error."""
    if value is None:
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value, (list, tuple)):
        return list(value)
    raise TypeError(f"expected None, str or list of str, got {type(value).__name__}")


@dataclass(frozen=True)
class EventAttributes:
    """Categorical and numerical attribute names of an event (features or targets)."""

    categorical: Sequence[str] = field(default_factory=tuple)
    numerical: Sequence[str] = field(default_factory=tuple)

    @staticmethod
    def of(categorical=None, numerical=None) -> "EventAttributes":
        return EventAttributes(tuple(as_list(categorical)), tuple(as_list(numerical)))

    @property
    def total_categorical(self) -> int:
        return len(self.categorical)

    @property
    def total_numerical(self) -> int:
        return len(self.numerical)

    @property
    def n_features(self) -> int:
        return self.total_categorical + self.total_numerical

    @property
    def names(self) -> list:
        return [*self.categorical, *self.numerical]


def feature_set(name) -> list:
    """``"all"`` expands to the ten numeric time features; None -> []."""
    if name is None:
        return []
    if name == "all":
        return list(NUMERICAL_FEATURES)
    return as_list(name)
