"""Which columns of a table play which part in a panel.

A spec is resolved against a schema only (no Spark job), so every operator can
build one static plan from it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

# Names the monthly staffing extract uses, the names they get
# here, and the lag distances of the derived features.
DATE_NAME = "MES_REF"
TARGET_NAME = "TO_TURNOVER_TO-GERAL"
GROUP_NAME = "area_anonn"
RENAMES = {
    "TO_ADMISSOES_ADMISSOES-MES-ATUAL": "admissions",
    "TO_HEADCOUNT_HEADCOUNT-MES-ATUAL": "headcount",
}
COMPONENT_NAMES = (
    "TO_TURNOVER_TO-VOL",
    "TO_TURNOVER_TO-INVOL",
    "TO_DESLIGAMENTO_DESLIGAMENTO-MES-ATUAL",
    "TO_DESLIGAMENTO_DESLIGAMENTO-VOLUNTARIO-MES-ATUAL",
    "TO_DESLIGAMENTO_DESLIGAMENTO-INVOLUNTARIO-MES-ATUAL",
    "TO_HEADCOUNT-TO_HEADCOUNT-MES-ATUAL",
    "TO_TURNOVER_TO-VOL-HEAD-GT-25",
)
DATE_HINTS = ("date", "mes")
TARGET_HINTS = ("turnover",)
EXOGENOUS_LAGS = (1, 3, 6)
COMPONENT_LAGS = (1, 3)
ROLLING_MEANS = (3, 6)
ROLLING_STDS = (6,)


@dataclass(frozen=True)
class PanelSpec:
    """Column roles and feature settings of one panel.

    ``grain`` says how long a group's history can get. ``"month"`` truncates
    dates to the month: with one row per (group, month) a group holds at most
    twelve rows a year, so a window per group is bounded. ``"row"`` keeps the
    dates as they are and assumes nothing about the length of a group; the
    window operators then work on blocks of rows instead of whole groups.
    """

    date: str = DATE_NAME
    target: str = TARGET_NAME
    group: str = GROUP_NAME
    weight: str = "headcount"
    admissions: str = "admissions"
    components: tuple[str, ...] = COMPONENT_NAMES
    n_lags: int = 12
    grain: str = "month"
    leak_free: bool = True

    def __post_init__(self):
        if self.grain not in ("month", "row"):
            raise ValueError(f"grain must be 'month' or 'row', not {self.grain!r}")
        if self.n_lags < 1:
            raise ValueError("n_lags must be at least 1")

    @property
    def group_code(self) -> str:
        return f"{self.group}_encoded"

    def present_components(self, columns: Sequence[str]) -> list[str]:
        return [c for c in self.components if c in columns]

    @property
    def longest_look_back(self) -> int:
        return max(self.n_lags, *EXOGENOUS_LAGS, *COMPONENT_LAGS, *ROLLING_MEANS, *ROLLING_STDS)

    def resolve(self, columns: Sequence[str], grouped: bool = True) -> PanelSpec:
        """Fill in the date and target columns by name when the usual ones are absent.

        The first column whose lower-cased name contains a hint is taken. The
        group column must be there too unless ``grouped`` is false.
        """
        date = _discover(self.date, columns, DATE_HINTS)
        target = _discover(self.target, columns, TARGET_HINTS)
        missing = [c for c in (date, target, *([self.group] if grouped else [])) if c not in columns]
        if missing:
            raise ValueError(f"columns {missing} not found in {list(columns)}")
        return replace(self, date=date, target=target)


def _discover(name: str, columns: Sequence[str], hints: Sequence[str]) -> str:
    if name in columns:
        return name
    hits = (c for c in columns if any(h in c.lower() for h in hints))
    return next(hits, name)


def feature_columns(columns: Sequence[str], spec: PanelSpec) -> tuple[list[str], list[str]]:
    """Split the model inputs of a feature frame into (numeric, pass-through).

    The forecast month's own measures are parts of the target or only known
    once the month is over; ``leak_free`` leaves them out.
    """
    left_out = {spec.date, spec.target, spec.group, "split", spec.group_code, "is_december"}
    if spec.leak_free:
        left_out |= {spec.weight, spec.admissions, *spec.components}
    numeric = [c for c in columns if c not in left_out]
    passed = [c for c in (spec.group_code, "is_december") if c in columns]
    return numeric, passed
