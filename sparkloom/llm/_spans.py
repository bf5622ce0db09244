"""Positions of regular-expression matches, with SQL functions only.

Spark's functions return the matched strings but not where they stand. Pieces
between matches and matches alternate, so running sums of their lengths give
the positions, in code points. Appending to an array copies it, so running
values are built in chunks; the work then grows with the number of matches
and not with its square, also in one very long text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of a chunk of running values, and code points of a block of text.
CHUNK = 256
BLOCK = 1024


def quoted(pattern: str) -> str:
    """A raw SQL string literal of a regular expression."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pieces_and_matches(text: str, pattern: str, guard: str) -> str:
    """A struct of the pieces between matches and the matches; ``guard`` is a cheap necessary condition."""
    p = quoted(pattern)
    return (
        f"CASE WHEN {guard} THEN named_struct('p', split({text}, {p}, -1), 'm', regexp_extract_all({text}, {p}, 0)) "
        "ELSE named_struct('p', cast(array() as array<string>), 'm', cast(array() as array<string>)) END"
    )


def running(array: str, start: str, step, kind: str = "int") -> str:
    """The running values of ``step(value, element)`` over an array column, from ``start``."""
    none = f"cast(array() as array<{kind}>)"
    chunk = (
        f"aggregate(slice({array}, b * {CHUNK} + 1, {CHUNK}), named_struct('at', acc.at, 'out', {none}), "
        f"(x, e) -> named_struct('at', {step('x.at', 'e')}, 'out', concat(x.out, array({step('x.at', 'e')}))))"
    )
    return (
        f"CASE WHEN size({array}) = 0 THEN {none} ELSE "
        f"aggregate(sequence(0, (size({array}) - 1) div {CHUNK}), named_struct('at', {start}, 'out', {none}), "
        f"(acc, b) -> aggregate(array({chunk}), acc, (a, r) -> named_struct('at', r.at, 'out', concat(a.out, r.out))), acc -> acc.out) END"
    )


def located(rows: DataFrame, columns: tuple[str, ...], found: dict[str, str], context: int = 40) -> DataFrame:
    """``columns`` and, for each struct column of ``found`` (from ``pieces_and_matches``), an array of spans.

    ``found`` gives the kind of each column's spans. A span has kind, start,
    stop, token, and up to ``context`` characters before and after it.
    """
    names = list(found)
    sized = rows.select(*columns, *names, *[F.expr(f"transform({c}.m, (x, i) -> length({c}.p[i]) + length(x))").alias(f"_n{c}") for c in names])
    ended = sized.select(*columns, *names, *[F.expr(running(f"_n{c}", "0", lambda a, e: f"{a} + {e}")).alias(f"_e{c}") for c in names])
    span = lambda c: (
        f"transform({c}.m, (x, i) -> named_struct('kind', '{found[c]}', 'start', _e{c}[i] - length(x), 'stop', _e{c}[i], "
        f"'token', x, 'before', right({c}.p[i], {context}), 'after', left({c}.p[i + 1], {context})))"
    )
    return ended.select(*columns, *[F.expr(span(c)).alias(c) for c in names])


def outside(rows: DataFrame, columns: tuple[str, ...], fixed: str, more: str) -> DataFrame:
    """``columns``, ``fixed`` and of the spans ``more`` those that overlap none of ``fixed``, by one pass over both in order.

    Both are arrays of (kind, start, stop).
    """
    entry = lambda c, w: f"transform({c}, s -> named_struct('start', s.start, 'w', {w}, 'stop', s.stop, 'kind', s.kind))"
    none = f"cast(array() as array<struct<start:int,w:int,stop:int,kind:string>>)"  # noqa: F541
    every = f"CASE WHEN size({more}) = 0 THEN {none} ELSE array_sort(concat({entry(fixed, 0)}, {entry(more, 1)})) END"
    rows = rows.select(*columns, fixed, F.expr(every).alias("_u"))
    rows = rows.select(*columns, fixed, "_u", F.expr("reverse(_u)").alias("_v"))
    rows = rows.select(
        *columns, fixed, "_u",
        F.expr(running("_u", "-1", lambda a, e: f"greatest({a}, IF({e}.w = 0, {e}.stop, -1))")).alias("_reach"),
        F.expr(running("_v", "2147483647", lambda a, e: f"least({a}, IF({e}.w = 0, {e}.start, 2147483647))")).alias("_next"),
    )
    free = "filter(_u, (x, i) -> x.w = 1 AND _reach[i] <= x.start AND _next[size(_u) - 1 - i] >= x.stop)"
    slim = f"transform({free}, x -> named_struct('kind', x.kind, 'start', x.start, 'stop', x.stop))"
    return rows.select(*columns, fixed, F.expr(slim).alias(more))


def in_order(spans: str, kinds: tuple[str, ...], by_kind: bool) -> str:
    """Spans by kind as listed and then start, or by start and then kind."""
    listed = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    k, at = f"'k', array_position({listed}, s.kind)", "'start', s.start"
    key = f"{k}, {at}" if by_kind else f"{at}, {k}"
    keyed = f"transform({spans}, s -> named_struct({key}, 'stop', s.stop, 'kind', s.kind))"
    return f"transform(array_sort({keyed}), s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop))"


def joined(column: str) -> str:
    """``kind:start:end``, comma-joined."""
    return f"array_join(transform({column}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"


def _cut(a: str, b: str) -> str:
    """Code points a to b (exclusive) of the text whose blocks are in ``_blocks``."""
    return (
        f"CASE WHEN {a} >= {b} THEN '' WHEN {a} div {BLOCK} = ({b} - 1) div {BLOCK} THEN substring(_blocks[cast({a} div {BLOCK} as int)], {a} % {BLOCK} + 1, {b} - {a}) "
        f"ELSE concat(substring(_blocks[cast({a} div {BLOCK} as int)], {a} % {BLOCK} + 1), "
        f"array_join(slice(_blocks, cast({a} div {BLOCK} as int) + 2, cast(({b} - 1) div {BLOCK} - {a} div {BLOCK} as int) - 1), ''), "
        f"substring(_blocks[cast(({b} - 1) div {BLOCK} as int)], 1, ({b} - 1) % {BLOCK} + 1)) END"
    )


def redacted(rows: DataFrame, columns: tuple[str, ...], text: str, spans: str) -> DataFrame:
    """``columns`` and ``text`` with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    ordered = f"transform(array_sort(transform({spans}, s -> named_struct('start', s.start, 'back', -s.stop, 'kind', s.kind))), s -> named_struct('start', s.start, 'stop', -s.back, 'kind', s.kind))"
    blocks = f"CASE WHEN size({spans}) = 0 THEN cast(array() as array<string>) ELSE regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0) END"
    rows = rows.select(*columns, text, F.expr(blocks).alias("_blocks"), F.expr(ordered).alias("_s"))
    rows = rows.select(*columns, text, "_blocks", "_s", F.expr(running("_s", "0", lambda a, e: f"greatest({a}, {e}.stop)")).alias("_reach"))
    # The first span of each overlapping run, and where the run before it ends.
    heads = "filter(transform(_s, (x, i) -> named_struct('start', x.start, 'kind', x.kind, 'end', IF(i = 0, 0, _reach[greatest(0, i - 1)]))), x -> x.start >= x.end)"
    rows = rows.select(*columns, text, "_blocks", "_reach", F.expr(heads).alias("_h"))
    parts = f"transform(_h, x -> concat({_cut('x.end', 'x.start')}, '[', upper(x.kind), ']'))"
    last = f"aggregate(array(element_at(_reach, -1)), '', (a, x) -> {_cut('x', f'length({text})')})"
    changed = f"CASE WHEN size(_h) = 0 THEN {text} ELSE concat(array_join({parts}, ''), {last}) END"
    return rows.select(*columns, F.expr(changed).alias(text))
