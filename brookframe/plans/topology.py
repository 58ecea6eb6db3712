"""A validated graph of sources, operators and sinks. Each node is a lazy DataFrame, so the plan is Catalyst's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookframe.functions.exact import require
from brookframe.operators import groups, joins, process, rows
from brookframe.sources.topics import merge

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True, eq=False)
class Node:
    name: str
    kind: str
    parents: tuple[Node, ...] = ()
    make: Callable | None = None
    topics: tuple[str, ...] = ()


@dataclass
class Topology:
    """Nodes in the order in which they were added; parents come before their children."""

    nodes: list[Node] = field(default_factory=list)

    def _add(self, node: Node) -> Node:
        if any(n.name == node.name for n in self.nodes):
            raise ValueError(f"there is a node named {node.name} already")
        for parent in node.parents:
            if not any(n is parent for n in self.nodes):
                raise ValueError(f"{parent.name} is a node of another topology")
            if parent.kind == "sink":
                raise ValueError(f"{parent.name} is a sink")
        self.nodes.append(node)
        return node

    def source(self, name: str, topics: list[str], decode: Step = lambda df: df) -> Node:
        if not topics:
            raise ValueError("a source has at least one topic")
        return self._add(Node(name, "source", make=decode, topics=tuple(sorted(topics))))

    def apply(self, name: str, parent: Node, step: Step) -> Node:
        """Any function from DataFrame to DataFrame."""
        return self._add(Node(name, "operator", (parent,), step))

    def process(self, name: str, parent: Node, function: Callable, schema) -> Node:
        """A function over Arrow batches that yields any number of batches for each (none drops it)."""
        return self.apply(name, parent, lambda df: df.mapInArrow(function, schema))

    def process_in_order(self, name: str, parent: Node, make: Callable, schema) -> Node:
        """A processor of one's own for each partition, in offset order."""
        return self.apply(name, parent, lambda df: process.process_in_order(df, make, schema))

    def filter(self, name: str, parent: Node, predicate: Column) -> Node:
        return self.apply(name, parent, lambda df: rows.filter_rows(df, predicate))

    def select(self, name: str, parent: Node, *columns: str) -> Node:
        return self.apply(name, parent, lambda df: rows.select_columns(df, *columns))

    def derive(self, name: str, parent: Node, *derived: rows.Derived) -> Node:
        return self.apply(name, parent, lambda df: rows.with_derived(df, *derived))

    def group(self, name: str, parent: Node, keys: list[str], aggs: list[groups.Agg], by_batch: bool = False) -> Node:
        if not keys:
            raise ValueError("grouping needs at least one key")
        return self.apply(name, parent, lambda df: groups.group_by(df, keys, aggs, by_batch))

    def window(self, name: str, parent: Node, keys: list[str], size: int, aggs: list[groups.Agg], retention: int | None = None, by_batch: bool = False) -> Node:
        if size < 1 or (retention is not None and retention < size):
            raise ValueError("a window has at least 1 ms, and retention at least its size")
        return self.apply(name, parent, lambda df: groups.windowed_group_by(df, keys, size, aggs, retention, by_batch))

    def merge(self, name: str, *parents: Node) -> Node:
        if len(parents) < 2:
            raise ValueError("a merge has at least two parents")
        return self._add(Node(name, "operator", parents, merge))

    def join(self, name: str, left: Node, right: Node, left_key: str, right_key: str, window: int, left_prefix: str = "left_", right_prefix: str = "right_", by_batch: bool = False) -> Node:
        if left is right:
            raise ValueError("a node is not joined with itself")
        if window < 0:
            raise ValueError("a window is not negative")
        return self._add(Node(name, "operator", (left, right), lambda a, b: joins.windowed_join(a, b, left_key, right_key, window, left_prefix, right_prefix, by_batch)))

    def sink(self, name: str, parent: Node, topic: str, encode: Step = lambda df: df) -> Node:
        return self._add(Node(name, "sink", (parent,), encode, (topic,)))

    def pass_through(self, name: str, parent: Node, topic: str) -> Node:
        """Copies undecoded records; only right under a source, which then need not be decoded."""
        if parent.kind != "source":
            raise ValueError("a pass-through sink stands right under a source")
        return self._add(Node(name, "pass", (parent,), None, (topic,)))

    def source_topics(self) -> list[str]:
        return sorted({t for n in self.nodes if n.kind == "source" for t in n.topics})

    def validate(self) -> None:
        kinds = {n.kind for n in self.nodes}
        if "source" not in kinds:
            raise ValueError("there is no source")
        if not kinds & {"sink", "pass"}:
            raise ValueError("there is no sink")

    def frames(self, topics: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The DataFrame of each node whose sources have a topic in ``topics``; topics that no source declares are ignored."""
        self.validate()
        out: dict[str, DataFrame] = {}
        undecoded: dict[str, DataFrame] = {}
        for n in self.nodes:
            if n.kind == "source":
                if there := [topics[t] for t in n.topics if t in topics]:
                    undecoded[n.name] = merge(*there)
                    out[n.name] = n.make(undecoded[n.name])
            elif n.kind == "pass":
                if n.parents[0].name in undecoded:
                    out[n.name] = undecoded[n.parents[0].name]
            elif all(p.name in out for p in n.parents):
                out[n.name] = n.make(*(out[p.name] for p in n.parents))
        return out

    def run(self, topics: dict[str, DataFrame], partition: int | None = None) -> dict[str, DataFrame]:
        """What each sink gets, by its name, over bounded inputs. With ``partition``, all records must be of that partition; one that isn't raises."""
        if partition is not None:
            own = require(F.col(groups.PARTITION), F.col(groups.PARTITION) == partition, f"a record is not of partition {partition}")
            topics = {name: df.withColumn(groups.PARTITION, own) for name, df in topics.items()}
        frames = self.frames(topics)
        return {n.name: frames[n.name] for n in self.nodes if n.kind in ("sink", "pass") and n.name in frames}
