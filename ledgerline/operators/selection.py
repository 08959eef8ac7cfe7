"""Exact order statistics without a sort: the rows at given ranks in the order (value, key).

Each wanted rank is a target that starts with the whole range of its measure. A round counts the rows of every target's range in
up to ``BUCKETS`` equal pieces and narrows the target to the piece that holds its rank; all measures and ranks share one
aggregate per round, so a round is one pass with map-side partial counts and moves at most ``BUCKETS`` rows per target and task. Where one value is left,
narrowing goes on within the key (an integer, or a string two bytes at a time), which takes apart any number of tied rows. As soon as a
range holds ``FETCH`` rows at most, they are fetched and sorted on the driver, all targets in one job. Ranges grow by
neither rows nor ties: 64-bit values take seven rounds at most, and usual data two or three.

Values are integers or decimals (whose unscaled value must stay below 2^62: checked); null values come first. Null
keys and ranks outside 1..n are errors. Rows with equal value and key are interchangeable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, StringType

BUCKETS = 1024
FETCH = 256
_WIDE = 1 << 62


@dataclass
class Level:
    """One step of the order: a long expression, its range, and into how many pieces a round cuts it."""
    code: Column
    low: int
    high: int
    pieces: int = BUCKETS


@dataclass
class Target:
    measure: str
    rank: int  # wanted rank, and within the range once it is narrowed
    left: int
    low: int
    high: int
    count: int
    level: int = 0
    fixed: tuple = field(default=())  # the codes of the levels before

    @property
    def place(self) -> tuple:
        return self.measure, self.level, self.fixed, self.low, self.high


def value_code(measure: str, df: DataFrame) -> Column:
    """A measure as a long in the same order."""
    kind = df.schema[measure].dataType
    if isinstance(kind, IntegralType):
        return F.col(measure).cast("long")
    if isinstance(kind, DecimalType):
        whole = F.col(measure) * F.lit(10 ** kind.scale).cast(DecimalType(kind.scale + 1, 0)) if kind.scale else F.col(measure)
        return whole.cast("decimal(38,0)").cast("long")
    raise TypeError(f"ranks need integers or decimals, {measure} is {kind.simpleString()}")


def key_levels(df: DataFrame, key: str, low, high, longest: int) -> list[Level]:
    """The key as levels: a number is its upper and its lower 32 bits, a string one level per two bytes after what all keys have in
    common, then its length."""
    if isinstance(df.schema[key].dataType, IntegralType):
        whole = F.col(key).cast("long")
        return [Level(F.shiftright(whole, 32), int(low) >> 32, int(high) >> 32),
                Level(whole.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 0, 0xFFFFFFFF)]
    if not isinstance(df.schema[key].dataType, StringType):
        raise TypeError(f"the key {key} must be a string or an integer")
    a, b = low.encode(), high.encode()
    common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    octets = F.col(key).cast("binary")
    # bytes beyond the end count as zero; the length then tells keys that end in zero bytes apart
    pair = lambda at: F.conv(F.rpad(F.hex(F.substring(octets, at + 1, 2)), 4, "0"), 16, 10).cast("long")
    return [Level(pair(at), 0, 0xFFFF, 0x10000) for at in range(common, longest, 2)] + [Level(F.octet_length(key).cast("long"), 0, longest)]


def _inside(levels: list[Level], place: tuple) -> Column:
    _, level, fixed, low, high = place
    found = levels[level].code.between(low, high)
    for before, code in zip(levels, fixed):
        found = found & (before.code == code)
    return found


def rows_at_ranks(df: DataFrame, wanted: dict[str, list[int]], key: str) -> dict[str, dict[int, tuple]]:
    """{measure: {rank: (measure value, key value)}} for the wanted 1-based ranks of each measure. ``df`` is read once per round: hand in
    a materialised frame."""
    wanted = {m: sorted(set(ranks)) for m, ranks in wanted.items()}
    measures = [m for m, ranks in wanted.items() if ranks]
    out: dict[str, dict[int, tuple]] = {m: {} for m in wanted}
    if not measures:
        return out
    codes = {m: value_code(m, df) for m in measures}
    bounds = df.agg(F.count("*").alias("n"), F.min(key).alias("low_key"), F.max(key).alias("high_key"), F.count(key).alias("keys"),
                    F.max(F.octet_length(F.col(key).cast("string"))).alias("longest"), *[f for i, m in enumerate(measures) for f in (
                        F.min(codes[m]).alias(f"low{i}"), F.max(codes[m]).alias(f"high{i}"), F.count(codes[m]).alias(f"n{i}"))]).first()
    n = bounds["n"]
    if bounds["keys"] < n:
        raise ValueError(f"null keys in {key}")
    levels = {}
    for i, m in enumerate(measures):
        if wanted[m][0] < 1 or wanted[m][-1] > n:
            raise ValueError(f"ranks of {m} must lie in 1..{n}")
        low, high = bounds[f"low{i}"] or 0, bounds[f"high{i}"] or 0
        if max(abs(low), abs(high)) >= _WIDE:
            raise OverflowError(f"values of {m} exceed 62 bits")
        tail = key_levels(df, key, bounds["low_key"], bounds["high_key"], bounds["longest"])
        # nulls are one code below the least value
        levels[m] = [Level(F.coalesce(codes[m], F.lit(low - 1).cast("long")), low - (bounds[f"n{i}"] < n), high), *tail]
    targets = [Target(m, r, r, levels[m][0].low, levels[m][0].high, n) for m in measures for r in wanted[m]]

    while active := [t for t in targets if t.count > FETCH and t.level < len(levels[t.measure])]:
        counts = _counted(df, levels, list(dict.fromkeys(t.place for t in active)))
        for t in active:
            _narrow(t, levels[t.measure], counts[t.place])

    places = list(dict.fromkeys(t.place for t in targets if t.level < len(levels[t.measure])))
    rows = _fetched(df, levels, places, key)
    for t in targets:
        if t.level < len(levels[t.measure]):
            out[t.measure][t.rank] = rows[t.place][t.left - 1]
    same = [t for t in targets if t.level == len(levels[t.measure])]  # only equal rows are left: any of them
    for t in same:
        cond = _inside(levels[t.measure], (t.measure, len(t.fixed) - 1, t.fixed[:-1], t.fixed[-1], t.fixed[-1]))
        out[t.measure][t.rank] = tuple(df.filter(cond).select(t.measure, key).first())
    return out


def _counted(df: DataFrame, levels: dict[str, list[Level]], places: list[tuple]) -> dict[tuple, list[tuple]]:
    """Per place its pieces that hold rows, in order: (first code, last code, rows)."""
    kinds = []
    for i, place in enumerate(places):
        m, level, _, low, high = place
        step = levels[m][level]
        width = -(-(high - low + 1) // step.pieces)
        piece = F.call_function("div", step.code - low, F.lit(width).cast("long"))
        kinds.append(F.when(_inside(levels[m], place), F.struct(F.lit(i).alias("place"), piece.alias("piece"))))
    hits = df.select(F.explode(F.array_compact(F.array(*kinds))).alias("hit"))
    found: dict[tuple, list[tuple]] = {p: [] for p in places}
    for row in sorted(hits.groupBy("hit.place", "hit.piece").count().collect()):
        place = places[row["place"]]
        m, level, _, low, high = place
        width = -(-(high - low + 1) // levels[m][level].pieces)
        first = low + row["piece"] * width
        found[place].append((first, min(high, first + width - 1), row["count"]))
    return found


def _narrow(target: Target, levels: list[Level], pieces: list[tuple]) -> None:
    for low, high, count in pieces:
        if target.left <= count:
            break
        target.left -= count
    target.low, target.high, target.count = low, high, count
    while target.low == target.high and target.count > FETCH:  # one code is left: go on within the next level
        target.fixed += (target.low,)
        target.level += 1
        if target.level == len(levels):
            return
        target.low, target.high = levels[target.level].low, levels[target.level].high


def _fetched(df: DataFrame, levels: dict[str, list[Level]], places: list[tuple], key: str) -> dict[tuple, list[tuple]]:
    """The rows (value, key) of each place, sorted: at most ``FETCH`` per place."""
    measures = list(dict.fromkeys(p[0] for p in places))
    found: dict[tuple, list[tuple]] = {p: [] for p in places}
    if not places:
        return found
    hit = F.array_compact(F.array(*[F.when(_inside(levels[p[0]], p), F.lit(i)) for i, p in enumerate(places)]))
    for row in df.select(F.explode(hit).alias("_place"), *measures, F.col(key).alias("_key")).collect():
        place = places[row["_place"]]
        found[place].append((row[place[0]], row["_key"]))
    order = lambda x: (x[0] is not None, 0 if x[0] is None else x[0], x[1].encode() if isinstance(x[1], str) else x[1])
    return {p: sorted(rows, key=order) for p, rows in found.items()}
