from oddslake.functions.computed import computed, fenced
from oddslake.functions.joins import salted_join
from oddslake.functions.ordered import lag_ordered, latest_by, row_number_ordered, running_sum
from oddslake.functions.scalar import (
    book_flags,
    cents,
    csv_safe_column,
    exact,
    finite,
    first_present,
    fingerprint,
    instant,
    json_list,
    json_objects,
    midpoint,
    number,
    probability,
    sorted_set,
    strict_epoch,
    to_epoch,
    truthy,
    valid_probability,
)
from oddslake.functions.text import ascii_only, casefold, nfkc, python_lines, term_pattern, term_tokens, tokens

__all__ = [
    "ascii_only",
    "book_flags",
    "casefold",
    "cents",
    "computed",
    "csv_safe_column",
    "exact",
    "fenced",
    "finite",
    "first_present",
    "fingerprint",
    "instant",
    "json_list",
    "json_objects",
    "lag_ordered",
    "latest_by",
    "midpoint",
    "nfkc",
    "number",
    "probability",
    "python_lines",
    "row_number_ordered",
    "running_sum",
    "salted_join",
    "sorted_set",
    "strict_epoch",
    "term_pattern",
    "term_tokens",
    "to_epoch",
    "tokens",
    "truthy",
    "valid_probability",
]
