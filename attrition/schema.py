"""Column-name configuration (model name -> target / numeric / categorical lists).

The column names below are fixed values: they are the names of the usage
panel's features and must be spelled exactly like this for the ratio rules,
the dashboard drivers and the profiler to find them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

KEY = "user_account_id"
YEAR = "year"
MONTH = "month"
KEY_COLUMNS = (KEY, YEAR, MONTH)
LABEL = "churn"
MONTHS_PRESENT = "Totalmonths"
EXPLORATORY_LABEL = "Churn"

# Full feature list of the telecom usage panel, in its natural order.
FULL_FEATURES = (
    "user_lifetime", "user_intake", "user_no_outgoing_activity_in_days",
    "user_account_balance_last", "user_spendings", "user_has_outgoing_calls",
    "user_has_outgoing_sms", "user_use_gprs", "user_does_reload",
    "reloads_inactive_days", "reloads_count", "reloads_sum",
    "calls_outgoing_count", "calls_outgoing_spendings", "calls_outgoing_duration",
    "calls_outgoing_spendings_max", "calls_outgoing_duration_max",
    "calls_outgoing_inactive_days",
    "calls_outgoing_to_onnet_count", "calls_outgoing_to_onnet_spendings",
    "calls_outgoing_to_onnet_duration", "calls_outgoing_to_onnet_inactive_days",
    "calls_outgoing_to_offnet_count", "calls_outgoing_to_offnet_spendings",
    "calls_outgoing_to_offnet_duration", "calls_outgoing_to_offnet_inactive_days",
    "calls_outgoing_to_abroad_count", "calls_outgoing_to_abroad_spendings",
    "calls_outgoing_to_abroad_duration", "calls_outgoing_to_abroad_inactive_days",
    "sms_outgoing_count", "sms_outgoing_spendings", "sms_outgoing_spendings_max",
    "sms_outgoing_inactive_days",
    "sms_outgoing_to_onnet_count", "sms_outgoing_to_onnet_spendings",
    "sms_outgoing_to_onnet_inactive_days",
    "sms_outgoing_to_offnet_count", "sms_outgoing_to_offnet_spendings",
    "sms_outgoing_to_offnet_inactive_days",
    "sms_outgoing_to_abroad_count", "sms_outgoing_to_abroad_spendings",
    "sms_outgoing_to_abroad_inactive_days",
    "sms_incoming_count", "sms_incoming_spendings",
    "sms_incoming_from_abroad_count", "sms_incoming_from_abroad_spendings",
    "gprs_session_count", "gprs_usage", "gprs_spendings", "gprs_inactive_days",
    "last_100_reloads_count", "last_100_reloads_sum",
    "last_100_calls_outgoing_duration", "last_100_calls_outgoing_to_onnet_duration",
    "last_100_calls_outgoing_to_offnet_duration", "last_100_calls_outgoing_to_abroad_duration",
    "last_100_sms_outgoing_count", "last_100_sms_outgoing_to_onnet_count",
    "last_100_sms_outgoing_to_offnet_count", "last_100_sms_outgoing_to_abroad_count",
    "last_100_gprs_usage",
)

# 0/1 monthly indicator columns used for the churn-rate-by-level view.
INDICATORS = ("user_intake_sum", "user_has_outgoing_calls", "user_has_outgoing_sms",
              "user_use_gprs", "user_does_reload")

# The named churn drivers of the dashboard.
DRIVER_NAMES = (
    "reloads_inactive_days", "user_lifetime", "sms_outgoing_inactive_days",
    "sms_outgoing_to_onnet_inactive_days", "sms_outgoing_to_offnet_inactive_days",
    "sms_outgoing_to_abroad_inactive_days", "gprs_inactive_days",
    "calls_outgoing_inactive_days", "calls_outgoing_to_offnet_inactive_days",
    "calls_outgoing_to_onnet_inactive_days", "calls_outgoing_to_abroad_inactive_days",
    "calls_outgoing_count", "calls_outgoing_to_offnet_spendings", "sms_incoming_count",
    "user_has_outgoing_calls", "user_has_outgoing_sms", "user_account_balance_last",
    "calls_outgoing_duration_max",
)

# The drivers shown beside each scored account.
DASHBOARD_DRIVERS = (
    "calls_outgoing_duration_max", "user_account_balance_last", "user_has_outgoing_sms",
    "sms_outgoing_to_abroad_inactive_days", "user_lifetime", "reloads_inactive_days",
)

SCORE_COL = "logistic_regression_probability"
PREDICTION_COL = "prediction_logistic_regression"


@dataclass(frozen=True)
class ModelColumns:
    """Columns one model uses: keys, target, numeric and categorical features."""

    target: str
    num: tuple[str, ...]
    cat: tuple[str, ...] = ()
    keys: tuple[str, ...] = (KEY,)

    def selected(self) -> list[str]:
        return [*self.keys, self.target, *self.num, *self.cat]


@dataclass
class ModelRegistry:
    """Model name -> column configuration."""

    models: dict[str, ModelColumns] = field(default_factory=dict)

    def register(self, name: str, cols: ModelColumns) -> None:
        self.models[name] = cols

    def __getitem__(self, name: str) -> ModelColumns:
        return self.models[name]


def default_registry() -> ModelRegistry:
    reg = ModelRegistry()
    reg.register("churn_model_v1", ModelColumns(target=LABEL, num=FULL_FEATURES, cat=(),
                                                keys=KEY_COLUMNS))
    return reg


def numeric_columns(df, exclude=()) -> list[str]:
    """Names of numeric columns of ``df`` (in schema order), minus ``exclude``."""
    from pyspark.sql.types import NumericType

    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]
