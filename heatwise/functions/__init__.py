"""Column expressions: all JVM-side, codegen-friendly ``Column -> Column`` helpers."""

from heatwise.functions.exprs import (  # noqa: F401
    action_tier,
    equal_width_bin,
    hole_factor,
    hole_size_from_name,
    hole_size_from_path,
    lit_double,
    risk_level,
    safe_div,
    temp_category,
)
