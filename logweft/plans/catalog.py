"""All registered queries and their SQL twins."""

from __future__ import annotations

from logweft.plans.parsing import PARSING
from logweft.plans.dashboard import DASHBOARD
from logweft.plans.explaining import EXPLAINING
from logweft.plans.files import FILES
from logweft.plans.live import LIVE
from logweft.plans.registry import Query
from logweft.plans.traces import TRACES
from logweft.plans.training import TRAINING

GROUPS = [PARSING, TRACES, TRAINING, EXPLAINING, DASHBOARD, FILES, LIVE]


def queries() -> dict[str, Query]:
    return {name: query for group in GROUPS for name, query in group.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.oracles.items()}
