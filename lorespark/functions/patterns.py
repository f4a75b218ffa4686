"""Which texts hold which of many fixed strings, in one pass over the texts: an Aho-Corasick automaton of the strings reads every text once, whatever their number, so no pair of text and string is tried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of strings that make one automaton; more go over the texts again.
BLOCK_CHARS = 4 << 20


def _blocks(patterns: DataFrame) -> Iterator[list[str]]:
    block, size = [], 0
    for r in patterns.toLocalIterator():
        block.append(r[0])
        size += len(r[0]) + 1
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _held(block: list[str], column: str):
    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        always = [i for i, p in enumerate(block) if not p]  # the empty string is in every text
        for i, p in enumerate(block):
            if p:
                machine.add_word(p, i)
        machine.make_automaton()
        live = len(block) > len(always)
        for batch in batches:
            row, what = [], []
            for n, text in enumerate(batch.column(column).to_pylist()):
                if text is None:
                    continue
                got = {i for _, i in machine.iter(text)} if live and text else set()
                got.update(always)
                row += [n] * len(got)
                what += sorted(got)
            at = pa.array(np.array(row, np.int64))
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], pa.array([block[i] for i in what], pa.string())], names=[*batch.schema.names, "__pattern"])

    return run


def holding(texts: DataFrame, column: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """``texts`` joined with ``patterns`` where the text in ``column`` holds the string in ``pattern``: a row a pair. Strings (nulls hold nowhere) go to the texts in blocks of BLOCK_CHARS characters, each
    once however many rows name it; a text without any costs one reading and gives no row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields) + ", __pattern string"
    out = None
    for block in _blocks(patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern).cast("string")).distinct()):
        got = texts.mapInArrow(_held(block, column), schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = texts.withColumn("__pattern", F.lit(None).cast("string")).where("false")
    named = patterns.withColumn("__pattern", F.col(pattern).cast("string")).where("__pattern is not null")
    return out.join(named, "__pattern").drop("__pattern")
