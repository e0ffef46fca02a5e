"""Label policies: the three rule sets of the reference as parameters of one operator.

Fixed values (must equal the reference's for the same labels):

* ``four``  -- threshold 305 K; hole factors 20mm 0.8, 25mm 1.0, 30mm 1.2, 40mm 1.5, other 1.0;
              outlier share > 0.1*f; hot share > 0.15*f; mean > thr - 3; sample std > 8*f.
* ``six``   -- the four above plus max > thr + 5*f and, only when some reading is hot,
              hot share > 0.1; large-hole boost (+0.2) and every-4th-file boost (+0.1).
* ``three`` -- threshold 308 K; hole factors 20mm 0.95, 25mm 1.0, 30mm 1.05, 40mm 1.1, other 1.0;
              hot share > 0.25; mean > thr - 2; max > thr + 8; leak when at least 2 hold.
* sensitivity cut-offs: strict >= total - 1, sensitive >= 1, balanced >= total // 2.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values -------------------------------------------------------------------------
HOLE_SIZES = ("20mm", "25mm", "30mm", "40mm")
FACTORS_FOUR_SIX = {"20mm": 0.8, "25mm": 1.0, "30mm": 1.2, "40mm": 1.5}
FACTORS_THREE = {"20mm": 0.95, "25mm": 1.0, "30mm": 1.05, "40mm": 1.1}
AMBIENT_K = 300.0
DEFAULT_TARGET_LEAK_RATIO = 0.4
DEFAULT_SEED = 42
SENSITIVITIES = ("strict", "balanced", "sensitive")
# --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LabelPolicy:
    name: str
    threshold: float
    factors: dict = field(default_factory=dict)
    default_factor: float = 1.0
    # criteria switches
    use_outliers: bool = True
    use_std: bool = True
    use_max: bool = False
    use_spatial: bool = False
    # constants of the criteria (multiplied by the hole factor where noted)
    outlier_share: float = 0.1          # x factor
    hot_share: float = 0.15             # x factor (four/six); plain for three
    hot_share_scaled: bool = True
    mean_margin: float = 3.0            # mean > thr - margin
    std_limit: float = 8.0              # x factor
    max_margin: float = 5.0             # max > thr + margin (x factor for six, plain for three)
    max_margin_scaled: bool = True
    spatial_share: float = 0.1
    # decision
    fixed_min_count: int | None = None  # three: leak if count >= 2 regardless of sensitivity
    large_hole_boost: bool = False
    file_index_boost: bool = False
    method: str | None = None           # fixed method name (three)


FOUR = LabelPolicy(name="four", threshold=305.0, factors=FACTORS_FOUR_SIX)

SIX = LabelPolicy(name="six", threshold=305.0, factors=FACTORS_FOUR_SIX, use_max=True,
                  use_spatial=True, large_hole_boost=True, file_index_boost=True)

THREE = LabelPolicy(name="three", threshold=308.0, factors=FACTORS_THREE, use_outliers=False,
                    use_std=False, use_max=True, hot_share=0.25, hot_share_scaled=False,
                    mean_margin=2.0, max_margin=8.0, max_margin_scaled=False,
                    fixed_min_count=2, method="simplified_balanced")

POLICIES = {"four": FOUR, "six": SIX, "three": THREE}


def policy(name_or_policy) -> LabelPolicy:
    if isinstance(name_or_policy, LabelPolicy):
        return name_or_policy
    try:
        return POLICIES[name_or_policy]
    except KeyError as exc:
        raise ValueError(f"unknown label policy {name_or_policy!r}; "
                         f"expected one of {sorted(POLICIES)}") from exc
