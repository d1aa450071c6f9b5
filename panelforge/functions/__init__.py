"""Column functions: every one maps columns to a column and stays in the JVM."""

from panelforge.functions.bins import bin_label, bin_interval, width_bin
from panelforge.functions.dates import calendar_columns, parse_ts, season, to_ntz
from panelforge.functions.lookup import (
    alias_values,
    code_labels,
    lookup,
    prefix_group,
)
from panelforge.functions.missing import nan_to_null, in_range
from panelforge.functions.stats import (
    capped,
    line_p_value,
    regression_metric_columns,
    zscore,
)

__all__ = [
    "alias_values", "bin_interval", "bin_label", "calendar_columns", "capped",
    "code_labels", "in_range", "lookup", "nan_to_null", "line_p_value", "parse_ts",
    "prefix_group", "regression_metric_columns", "season", "to_ntz", "width_bin", "zscore",
]
