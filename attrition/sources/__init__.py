"""Sources and sinks."""

from .fixtures import account_label, scored_accounts, usage_panel  # noqa: F401
from .sinks import (  # noqa: F401
    load_model, read_weights, replace_table, save_bucketed_table, save_model, save_table, schema_report,
    write_predictions_csv, write_to_table, write_weights,
)
from .tables import TABLE_NAMES, peek, query_view, read_catalog_table, read_csv, read_table  # noqa: F401
