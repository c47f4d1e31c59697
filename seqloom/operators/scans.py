"""Sums and other states that run over a whole ordered table and start anew wherever a rule cuts.

A cut depends on everything since the cut before, so partitions can't be walked on
their own. But what follows a cut depends on nothing before it. Each partition of the
sorted table therefore walks once for all places where the first cut in it may be,
which are no more than the items up to the first cut of a walk that starts there; walks
that cut at the same item are one from then on, and soon there is one. A partition says
in one row what it begins with and how each of these walks ends. The driver goes through
these rows in order, one a partition, and each partition then walks once more, knowing
how it was entered. States are the same numbers, added in the same order, as in one walk
over the whole table, however it is partitioned.

The rule must be monotone: a walk that has been entered cuts no later than one that starts
at a partition's first item. Rows without items are passed; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .homology import checkpointed


@dataclass(frozen=True)
class Rule:
    """begin(item) is the state after a cut before the item; step(state, item) is (whether it cuts, the state after the item)."""

    begin: Callable[[Any], Any]
    step: Callable[[Any, Any], tuple[bool, Any]]


def gate_rule(gate: float) -> Rule:
    """Cuts before an item if the sum since the last cut has reached the gate."""
    return Rule(lambda x: 0.0 + x, lambda s, x: (True, 0.0 + x) if s >= gate else (False, s + x))


def budget_rule(budget: int) -> Rule:
    """Cuts where one more item would make items times the longest pass the budget; state: [items, longest]."""

    def step(s, x):
        n, longest = s[0] + 1, max(s[1], x)
        return (True, [1, x]) if n * longest > budget else (False, [n, longest])

    return Rule(lambda x: [1, x], step)


def survey(items: Iterator, rule: Rule) -> tuple[list, list]:
    """(items up to the first cut of a walk from here, and how each walk ends: [state, size, cuts] by the item of its first cut)."""
    head: list = []
    walks: list[dict] = []  # state, size, cuts, and (first cut, its cuts less those of the walk) of those that are one by now
    start, searching = None, True
    for x in items:
        cut_here, others = None, []
        for w in walks:
            cut, w["state"] = rule.step(w["state"], x)
            w["size"] = 1 if cut else w["size"] + 1
            w["cuts"] += cut
            if cut and cut_here:
                cut_here["own"] += [(r, k + w["cuts"] - cut_here["cuts"]) for r, k in w["own"]]
                continue
            cut_here = w if cut else cut_here
            others.append(w)
        walks = others
        if searching:
            if cut_here:
                cut_here["own"].append((len(head), 1 - cut_here["cuts"]))
            else:
                walks.append({"state": rule.begin(x), "size": 1, "cuts": 1, "own": [(len(head), 0)]})
            head.append(x)
            if start is None:
                start = rule.begin(x)
            else:
                cut, start = rule.step(start, x)
                searching = not cut
    ends = sorted((r, w["state"], w["size"], w["cuts"] + k) for w in walks for r, k in w["own"])
    return head, [list(e[1:]) for e in ends]


def follow(entered, head: list, ends: list, rule: Rule):
    """[state, size, cuts] after a partition that is entered with such a one; None before the first item of all."""
    if not head:
        return entered
    if entered is None:
        return ends[0]
    state, size, cuts = entered
    for r, x in enumerate(head):
        cut, state = rule.step(state, x)
        if cut:
            return [ends[r][0], ends[r][1], cuts + ends[r][2]]
        size += 1
    return [state, size, cuts]


def resetting_scan(rows: DataFrame, order: list[str], items: Callable[[pa.RecordBatch], list[list]], rule: Rule, partitions: int | None = None) -> tuple[DataFrame, list | None]:
    """(rows with number, cuts and closed; the last [state, size, cuts] of all).

    items gives the items of each row of a batch. number: cuts before the row's first item, that one included; cuts:
    1 for each item before which there is one; closed: sizes of the segments that these cuts end.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))

    def said(batches):
        from pyspark import TaskContext

        head, ends = survey((x for batch in batches for row in items(batch) for x in row), rule)
        yield pa.RecordBatch.from_pydict({"id": [TaskContext.get().partitionId()], "said": [json.dumps([head, ends])]})

    parts = dealt.mapInArrow(said, "id long, said string").collect()  # one row a partition
    entered, at = {}, None
    for p in sorted(parts, key=lambda p: p.id):
        entered[p.id] = at
        at = follow(at, *json.loads(p.said), rule)
    names = [*dealt.columns, "number", "cuts", "closed"]

    def walk(batches):
        from pyspark import TaskContext

        now = entered[TaskContext.get().partitionId()]
        state, size, total = now or (None, 0, 0)
        for batch in batches:
            numbers, cuts, closed = [], [], []
            for row in items(batch):
                flags, ended = [], []
                for x in row:
                    if state is None:
                        cut, state = True, rule.begin(x)
                    else:
                        cut, state = rule.step(state, x)
                        if cut:
                            ended.append(size)
                    size = 1 if cut else size + 1
                    total += cut
                    flags.append(int(cut))
                    if len(flags) == 1:
                        numbers.append(total - 1)
                if not flags:
                    numbers.append(None)
                cuts.append(flags)
                closed.append(ended)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbers, pa.int64()), pa.array(cuts, pa.list_(pa.int32())), pa.array(closed, pa.list_(pa.int64()))], names
            )

    more = [("number", T.LongType()), ("cuts", T.ArrayType(T.IntegerType())), ("closed", T.ArrayType(T.LongType()))]
    return dealt.mapInArrow(walk, T.StructType([*dealt.schema.fields, *(T.StructField(*m) for m in more)])), at
