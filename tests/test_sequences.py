"""Windows built from events equal those cut from whole-case arrays."""

import pytest

from caseflow.operators import sequences as Q
from caseflow.sources.logs import load_log
from conftest import SF001


def rows(df, cols):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("options", [{}, {"block": 6}, {"block": 5, "hot_case_rows": 7}])
@pytest.mark.parametrize("k", [1, 4])
def test_event_windows_equal_array_windows(spark, options, k):
    log, spec = load_log(spark, "events_by_user", SF001)
    t = Q.traces(log, spec, ["activity", "seq"])
    want = rows(Q.prefix_windows(t, "activity", k, pad="-1"), ["case_id", "win_idx", "window"])
    assert rows(Q.case_prefix_windows(log, spec, "activity", k, pad="-1", **options), ["case_id", "win_idx", "window"]) == want
    for first in (False, True):
        a = Q.prefix_suffix(t, "seq", "seq", k, pad=0, include_first=first) if k > 1 else None
        if a is None:
            continue
        b = Q.case_prefix_suffix(log, spec, "seq", "seq", k, pad=0, include_first=first, **options)
        assert rows(b, ["case_id", "pair_idx", "prefix", "suffix"]) == rows(a, ["case_id", "pair_idx", "prefix", "suffix"])
