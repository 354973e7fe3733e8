"""Running a step tree: the commands on the path from the root to a node, folded into one DataFrame.

Nothing runs until the result is used, except ``outputTableName``, which writes a table. Captured
columns stay DataFrames. A command that cannot be built fails with the step's name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tributary.operators.exists import exists
from tributary.operators.filter import where
from tributary.operators.group import group
from tributary.operators.join import join
from tributary.operators.overlap import overlap
from tributary.operators.transform import UserFunction, transform
from tributary.operators.view import distinct_values, sort, view
from tributary.plans.tree import Command, Node, Sources
from tributary.sources.workspace import Workspace

STREAM = "stream"
#: Commands that take rows one by one, or none.
ROWWISE = {"filter", "transform", "define_variable", "multi_table"}


class StepError(ValueError):
    """A command could not be built."""


@dataclass
class State:
    """What flows from command to command. ``reusable`` says that the table still derives row by row
    from ``source``, so that a command naming that source continues with it."""

    df: DataFrame | None = None
    source: str | None = None
    reusable: bool = True
    order: Sequence = ()
    variables: dict[str, Any] = field(default_factory=dict)


def _seen(observation: Observation) -> int | None:
    try:
        return observation.get["rows"]
    except Py4JJavaError:  # a metric that was not in the plan has no row
        return None


@dataclass
class Plan:
    """A tree over the tables of a workspace.

    ``functions`` holds the Python functions of ``transform`` commands by output field or name.
    ``null_safe_joins`` lets null keys match. ``on_missing='pass'`` skips conditions and fields that
    name absent columns instead of failing.
    """

    tree: Node
    workspace: Workspace
    functions: Mapping[str, UserFunction] = field(default_factory=dict)
    null_safe_joins: bool = False
    on_missing: str = "error"

    def __post_init__(self):
        self.sources = Sources.of(self.tree)
        self._kept: list[DataFrame] = []
        self._outputs: dict[str, tuple[DataFrame, DataFrame]] = {}

    # -- results ---------------------------------------------------------------------------------

    def result(self, node_id: str, stop_at: str | None = None, view_id: str = "main") -> DataFrame:
        """The table at a node, or at one of its commands, or one of its sub-views."""
        return self._result(node_id, stop_at, view_id, ())

    def _result(self, node_id: str, stop_at: str | None, view_id: str, joining: tuple[str, ...]) -> DataFrame:
        if node_id in joining:
            raise StepError(f"node '{node_id}' is joined to itself through {list(joining)}")
        path = self._path(node_id)
        if view_id != "main":
            return self._sub_view(path, view_id, joining)
        state = State()
        for node in path:
            if node.enabled:
                self._node(state, node, stop_at if node.id == node_id else None, joining)
        return self._table(state)

    def _path(self, node_id: str) -> list[Node]:
        path = self.tree.path(node_id)
        if not path:
            raise StepError(f"no node '{node_id}' in the tree")
        return path

    def _table(self, state: State) -> DataFrame:
        return state.df if state.df is not None else self.workspace.spark.createDataFrame([], "none string").select()

    def _sub_view(self, path: Sequence[Node], view_id: str, joining: tuple[str, ...]) -> DataFrame:
        target = path[-1]
        found = [
            (command, sub)
            for command in target.ordered()
            if command.type == "multi_table"
            for sub in command.config.get("subTables") or []
            if sub.get("id") == view_id
        ]
        if not found:
            raise StepError(f"node '{target.name}' has no sub-view '{view_id}'")
        command, sub = found[0]
        state = State()
        for node in path:
            if node.enabled:
                self._node(state, node, None, joining, before=command.id if node is target else None)
        table = self.sources.resolve(sub["table"])
        if state.df is None:
            return self.workspace.table(table).limit(0)
        mains = [n for n, t in self.sources.tables.items() if t != table]
        tree = sub.get("onConditionGroup") or sub.get("conditionGroup")
        names = self.sources.names_of(table)
        return exists(self.workspace.table(table), state.df, sub.get("on"), tree, names, mains)

    def step_counts(self, node_id: str) -> DataFrame:
        """``(step, node_id, row_count)`` after each enabled node on the path that has a table.

        Nodes that follow each other and only take rows one by one share one scan: each count is observed as the rows pass. Such a run is
        read at once, here; a join, a group or a captured column starts another one. A node alone in its run is counted by a plan of its own, when the result is used.
        """
        state, runs = State(), []
        for node in self._path(node_id):
            if not node.enabled:
                continue
            before = replace(state, variables=dict(state.variables))
            self._node(state, node, None, ())
            if state.df is None:
                continue
            here = replace(state, variables=dict(state.variables))
            if runs and self._rowwise(node, before):
                runs[-1].append((node, here))
            else:
                runs.append([(node, here)])
        counts = []
        for run in runs:
            seen = self._observed(run) if len(run) > 1 else [None]
            for (node, at), count in zip(run, seen):
                counted = at.df.agg(F.count(F.lit(1)).alias("row_count")) if count is None else self.workspace.spark.range(1).select(F.lit(count).cast("long").alias("row_count"))
                counts.append(counted.select(F.lit(len(counts) + 1).alias("step"), F.lit(node.id).alias("node_id"), "row_count"))
        if not counts:
            return self.workspace.spark.createDataFrame([], "step int, node_id string, row_count long")
        return reduce(DataFrame.unionAll, counts)

    def _rowwise(self, node: Node, before: State) -> bool:
        """Whether a node continues with the table before it, row by row. A condition on a captured column is a join."""
        if before.df is None or any(isinstance(v, DataFrame) for v in before.variables.values()):
            return False
        for command in node.commands:
            wanted = command.config.get("dataSource")
            again = wanted and wanted != STREAM and not (before.reusable and before.source == self.sources.resolve(wanted))
            if command.type not in ROWWISE or again:
                return False
        return True

    def _observed(self, run: Sequence[tuple[Node, State]]) -> list[int | None]:
        """Row counts after each node of a run, from one job whose only stage that counts is its last, so that a retried task counts once.
        None for a count that the optimiser took out of the plan, as it does below a condition that never holds."""
        count = F.count(F.lit(1)).alias("rows")
        seen = [Observation() for _ in run]
        state = replace(run[0][1], variables=dict(run[0][1].variables))
        for (node, _), observation in zip(run, seen):
            if node is not run[0][0]:
                self._node(state, node, None, ())
            state.df = state.df.observe(observation, count)
        state.df.select(F.lit(1).alias("row")).write.format("noop").mode("overwrite").save()
        return [_seen(observation) for observation in seen]

    def branches(self, parent_id: str, persist: bool = False) -> list[tuple[str, DataFrame]]:
        """Results of a node's enabled children. They share the parent's result; ``persist`` keeps it on
        the executors, which pays when the shared steps are costly and the result is small; ``release`` lets it go."""
        path = self._path(parent_id)
        shared = State()
        for node in path:
            if node.enabled:
                self._node(shared, node, None, ())
        if persist and shared.df is not None:
            shared.df = shared.df.persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.append(shared.df)
        out = []
        for child in path[-1].children:
            if child.enabled:
                state = State(shared.df, shared.source, shared.reusable, shared.order, dict(shared.variables))
                self._node(state, child, None, ())
                out.append((child.name, self._table(state)))
        return out

    def release(self) -> None:
        """Let go of what ``persist`` kept. A plan used in a ``with`` statement does so at its end."""
        while self._kept:
            self._kept.pop().unpersist()

    def __enter__(self) -> Plan:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def _output_table(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as a table of the workspace. It is written again only if its plan, which names the versions of the tables it reads, is another,
        or if somebody has replaced the table."""
        before, saved = self._outputs.get(name, (None, None))
        if before is None or not before.sameSemantics(df) or not self.workspace.table(name).sameSemantics(saved):
            saved = self.workspace.save(name, df)
            self._outputs[name] = (df, saved)
        return saved

    def overlap(self, parent_id: str, persist: bool = False) -> DataFrame:
        """Shared distinct rows of each pair of enabled children."""
        return overlap(self.workspace.spark, self.branches(parent_id, persist))

    # -- commands --------------------------------------------------------------------------------

    def _node(
        self, state: State, node: Node, stop_at: str | None, joining: tuple[str, ...], before: str | None = None
    ) -> None:
        for command in node.ordered():
            if before and command.id == before:
                return
            try:
                self._command(state, command, (*joining, node.id))
            except StepError:
                raise
            except Exception as e:
                raise StepError(f"step '{node.name}', command {command.id} ({command.type}): {e}") from e
            if stop_at and command.id == stop_at:
                return

    def _load(self, state: State, name: str) -> None:
        state.df, state.source, state.reusable, state.order = self.workspace.table(name), name, True, ()

    def _command(self, state: State, command: Command, joining: tuple[str, ...]) -> None:
        c = command.config
        wanted = c.get("dataSource")
        if wanted and wanted != STREAM:
            table = self.sources.resolve(wanted)
            if state.df is None or not state.reusable or state.source != table:
                self._load(state, table)
        if command.type == "source":
            name = c.get("mainTable")
            if name and (name in self.workspace or self.on_missing == "error"):
                self._load(state, name)
            return
        if command.type == "define_variable":
            if c.get("variableName"):
                state.variables[c["variableName"]] = c.get("variableValue")
            return
        if state.df is None and c.get("mainTable") and command.type in ("filter", "sort", "transform", "save", "aggregate"):
            self._load(state, c["mainTable"])
        if state.df is None:
            return
        step = getattr(self, f"_do_{command.type}", None)
        if step is None:
            raise ValueError("unknown command type")
        step(state, c, joining)

    def _do_multi_table(self, state: State, c: Mapping[str, Any], joining) -> None:
        """The main table passes through; sub-views are asked for by id."""

    def _do_filter(self, state: State, c: Mapping[str, Any], joining) -> None:
        tree = c.get("filterRoot")
        if not tree and c.get("field"):
            tree = {k: c.get(k) for k in ("field", "operator", "value", "valueType", "dataType")}
        if tree:
            state.df = where(state.df, tree, state.variables, self.on_missing)

    def _do_save(self, state: State, c: Mapping[str, Any], joining) -> None:
        name, variable = c.get("field"), c.get("value")
        if name and variable:
            if name not in state.df.columns:
                if self.on_missing == "error":
                    raise ValueError(f"no column '{name}' to capture")
                return
            state.variables[str(variable)] = distinct_values(state.df, name, c.get("distinct") is not False)

    def _do_view(self, state: State, c: Mapping[str, Any], joining) -> None:
        sorts = c.get("viewSorts") or []
        if not sorts and c.get("viewSortField"):
            sorts = [{"field": c["viewSortField"], "ascending": c.get("viewSortAscending")}]
        state.df = view(state.df, c.get("viewFields") or [], sorts, c.get("viewLimit"), self.on_missing)
        kept = [s for s in sorts if s.get("field") in state.df.columns]
        state.order = kept or state.order

    def _do_sort(self, state: State, c: Mapping[str, Any], joining) -> None:
        state.df = sort(state.df, c.get("field"), c.get("ascending"), self.on_missing)
        if c.get("field") in state.df.columns:
            state.order = [{"field": c["field"], "ascending": c.get("ascending")}]

    def _do_transform(self, state: State, c: Mapping[str, Any], joining) -> None:
        state.df = transform(state.df, c.get("mappings") or [], state.variables, self.functions, self.on_missing)

    def _do_join(self, state: State, c: Mapping[str, Any], joining) -> None:
        if c.get("joinTargetType") == "node" and c.get("joinTargetNodeId"):
            right, right_names = self._result(c["joinTargetNodeId"], None, "main", joining), []
        elif c.get("joinTable"):
            table = self.sources.resolve(c["joinTable"])
            right, right_names = self.workspace.table(table), self.sources.names_of(table)
        else:
            raise ValueError("a join needs a table or a node to join to")
        # Every other known table name can only mean the table joined so far. In a self join the
        # table's own name is the left one and its aliases the right.
        left_names = [n for n in self.sources.tables if n not in right_names]
        if state.source in right_names:
            left_names, right_names = [*left_names, state.source], [n for n in right_names if n != state.source]
        state.df = join(
            state.df,
            right,
            c.get("on"),
            c.get("joinType") or "left",
            c.get("joinSuffix") or "_joined",
            self.null_safe_joins,
            state.variables,
            left_names,
            right_names,
        )
        state.order = ()

    def _do_group(self, state: State, c: Mapping[str, Any], joining) -> None:
        metrics = c.get("aggregations") or []
        if not metrics and c.get("field") and c.get("aggFunc"):
            metrics = [{"field": c["field"], "func": c["aggFunc"], "alias": f"{c['aggFunc']}_{c['field']}"}]
        keys = c.get("groupByFields") or c.get("groupBy") or []
        order = c.get("orderBy") or [s for s in state.order if s["field"] in state.df.columns]
        state.df = group(
            state.df,
            keys,
            metrics,
            c.get("havingConditions") or [],
            order,
            sort_keys=True,
            variables=state.variables,
            on_missing=self.on_missing,
        )
        state.order = [{"field": k} for k in keys if k in state.df.columns]
        state.reusable = False
        if c.get("outputTableName"):
            state.df = self._output_table(c["outputTableName"], state.df)

    _do_aggregate = _do_group
