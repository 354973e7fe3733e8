"""Branching table work on Spark: filters, joins, derived columns, groups, variables, step trees."""

from tributary.functions.casts import cast_fields, clean_nonfinite
from tributary.functions.predicates import condition, search
from tributary.functions.predicates import group as condition_group
from tributary.operators.detail import detail_rows, match_counts, nested_detail
from tributary.operators.exists import exists
from tributary.operators.filter import where
from tributary.operators.group import group, median
from tributary.operators.join import join
from tributary.operators.overlap import overlap
from tributary.operators.transform import UserFunction, transform
from tributary.operators.view import distinct_values, page, preview, sort, view
from tributary.plans.run import Plan, StepError
from tributary.plans.tree import read_tree, read_tree_file, set_enabled
from tributary.session import configure, tune
from tributary.sources.readers import read_csv, read_parquet, read_table, write_csv
from tributary.sources.workspace import Workspace

__all__ = [
    "Plan", "StepError", "UserFunction", "Workspace", "cast_fields", "clean_nonfinite", "condition",
    "condition_group", "configure", "detail_rows", "distinct_values", "exists", "group", "join",
    "match_counts", "median", "nested_detail", "overlap", "page", "preview", "read_csv",
    "read_parquet", "read_table", "read_tree", "read_tree_file", "search", "set_enabled", "sort",
    "transform", "tune", "view", "where", "write_csv",
]
