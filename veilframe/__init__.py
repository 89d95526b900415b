"""Discovery and masking of personal data in Spark tables, query results and streams."""

from .functions.prose import DEFAULT_RECOGNIZERS, EXTENDED_RECOGNIZERS, Recognizer, contains_pii, redact_text
from .functions.masks import mask, mask_by_entity
from .functions.jsontext import mask_json_text
from .functions.names import Classification
from .functions.sqltext import refused_as, table_hints, writes_data
from .operators.asof import asof_join
from .operators.classify import classify_columns, json_columns, json_keys, scan_tables
from .operators.findings import find_pii, rows_with_pii
from .operators.pseudonyms import unique_pseudonyms
from .operators.redact import redact
from .operators.sampling import sample_columns, vote_columns
from .plans.results import render, result_lines
from .plans.session import MaskedSession, QueryError
from .plans.gate import ReadOnlyError
from .plans.tuning import tune
from .policy import Policy, Rule
from .sources.writers import write_with_count
from .streaming.redaction import redact_stream, write_stream

__all__ = [
    "Classification",
    "DEFAULT_RECOGNIZERS",
    "EXTENDED_RECOGNIZERS",
    "MaskedSession",
    "Policy",
    "QueryError",
    "ReadOnlyError",
    "Recognizer",
    "Rule",
    "asof_join",
    "classify_columns",
    "contains_pii",
    "find_pii",
    "json_columns",
    "json_keys",
    "mask",
    "mask_by_entity",
    "mask_json_text",
    "redact",
    "redact_stream",
    "redact_text",
    "render",
    "result_lines",
    "rows_with_pii",
    "sample_columns",
    "scan_tables",
    "table_hints",
    "tune",
    "unique_pseudonyms",
    "vote_columns",
    "write_stream",
    "write_with_count",
    "refused_as",
    "writes_data",
]
