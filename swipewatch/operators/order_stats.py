"""Rolling quantiles over ``[t - w, t)`` per key, exact, for keys of any size.

Each key is a stream of values in time order, asked for the value at a rank among those in a window. A stream that fits
one task is answered there by a wavelet matrix: windows are ranges of places, and each bit of the values' ranks halves
the range that an answer can come from, for all windows of many keys at once.

A longer stream is first cut by value, into up to ``PARTS`` pieces by sketched cut values. Then it goes by time, in chunks:
a value enters once for all windows and leaves each window once, a chunk gets what each piece holds at its beginning, and
numpy follows each question bit by bit through the signed counts of the pieces to the one its answer lies in, and to the rank
there. Each piece is a shorter stream with the questions that lead to it; a piece that is one cut value answers at once.
Pieces that are still longer than ``PIECE_ROWS`` (and the limit) are divided again, by running counts (``plans.chunks``).

Results depend on key and instant only, so each pair is asked once, however many rows share it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_POLICY, ScalePolicy
from ..functions.scalars import window_label, window_micros
from ..plans.chunks import _size, _sketched, ordered_sums, plan_chunks
from ..sources.paths import fresh_path
from .rolling import quoted

CUTS = 16
PARTS = 1024  # most pieces of a key
PIECE_ROWS = 50_000  # pieces of so many rows are answered in one task
CHUNK_SHARE = 64  # a chunk holds at least so many rows for each piece whose count it is given
TASK_ROWS = 500_000
ASKS_PER_VALUE = 8  # a task takes so many times the chunk limit of questions
FLUSH_ROWS = 400_000


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wavelet_select(values: np.ndarray, first: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Value at 0-based ``rank`` among ``values[first:end]``, for many ranges at once."""
    distinct, codes = np.unique(values, return_inverse=True)
    found = np.zeros(len(first), np.int64)
    for bit in reversed(range(max(len(distinct) - 1, 0).bit_length())):
        ones = codes >> bit & 1
        zeros = np.concatenate([[0], np.cumsum(1 - ones)])
        left, right = zeros[first], zeros[end]
        up = rank >= right - left
        # the codes with a 0 come first, each half in its old order
        first = np.where(up, zeros[-1] + first - left, left)
        end = np.where(up, zeros[-1] + end - right, right)
        rank = np.where(up, rank - (right - left), rank)
        found |= up.astype(np.int64) << bit
        codes = np.concatenate([codes[ones == 0], codes[ones == 1]])
    return distinct[found] if len(distinct) else np.zeros(len(first))


def _answers(group: np.ndarray, t: np.ndarray, x: np.ndarray, is_value: np.ndarray, w, p, rank) -> tuple:
    """Places of the questions that have an answer, and the answers. Rows are sorted by group and ``t``."""
    asks = np.flatnonzero(~is_value)
    values = np.flatnonzero(is_value)
    # the edges of the windows among the values: an edge comes before a value of the same instant
    at = np.concatenate([t[asks] - w[asks], t[asks], t[values]])
    of = np.concatenate([group[asks], group[asks], group[values]])
    kind = np.repeat([0, 1], [2 * len(asks), len(values)])
    order = np.lexsort((kind, at, of))
    before = np.empty(len(order), np.int64)
    before[order] = np.cumsum(kind[order]) - kind[order]
    first, end = before[: len(asks)], before[len(asks) : 2 * len(asks)]
    some = end > first
    asks, first, end = asks[some], first[some], end[some]
    given = rank[asks]
    spot = np.where(given >= 0, given.astype(float), p[asks] * (end - first - 1))
    low = np.floor(spot).astype(np.int64)
    high = np.ceil(spot).astype(np.int64)
    x = x[values]
    a = wavelet_select(x, first, end, low)
    b = wavelet_select(x, first, end, high)
    return asks, np.where(a == b, a, a + (b - a) * (spot - low))


_STREAM = ["k", "node", "salt"]


def _changes(table: pa.Table, columns) -> np.ndarray:
    """Whether a row differs from the one before it in one of the columns; the first one does not."""
    new = np.zeros(table.num_rows, bool)
    for c in columns:
        column = table.column(c)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
    return new


def _by_streams(columns, solve):
    """For ``mapInArrow``: ``solve`` gets tables of whole streams; rows are sorted by the ``columns`` that name a stream."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < FLUSH_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            # the last stream may go on in the next batch
            last = np.ones(table.num_rows, bool)
            for c in columns:
                last &= pc.equal(table.column(c), table.column(c)[table.num_rows - 1]).to_numpy()
            cut = int(np.flatnonzero(last)[0])
            if cut:
                yield from solve(table.slice(0, cut).combine_chunks())
                table = table.slice(cut).combine_chunks()
            held, n = table.to_batches(), table.num_rows
        if n:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _solved(values: DataFrame, asks: DataFrame, limit: int, tasks: int) -> DataFrame:
    """(k, t, w, p, weight, value) for each question of streams that fit one task."""
    wide = asks.groupBy("k", "node").agg(F.count("*").alias("n")).where(F.col("n") > ASKS_PER_VALUE * limit)
    # a stream with very many questions is given to several tasks; these streams are few
    wide = wide.select(F.col("k").alias("wk"), F.col("node").alias("wn"), F.ceil(F.col("n") / (ASKS_PER_VALUE * limit)).alias("parts"))
    wide = F.broadcast(_stored(wide, "wide"))
    same = F.expr("k = wk AND node = wn")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    v = values.join(wide, same, "left").select(
        "k", "node", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"), "t", "x",
        F.lit(0).cast("long").alias("w"), F.lit(0.0).alias("p"), F.lit(-1.0).alias("rank"), F.lit(0.0).alias("weight"),
    )
    a = asks.join(wide, same, "left").select(
        "k", "node", F.pmod(F.xxhash64("t", "w", "p"), parts).alias("salt"), "t", F.lit(None).cast("double").alias("x"),
        "w", "p", "rank", "weight",
    )
    rows = v.unionByName(a).repartition(tasks, *_STREAM).sortWithinPartitions(*_STREAM, "t")
    kind = rows.schema["k"].dataType.simpleString()

    def solve(table: pa.Table):
        new = _changes(table, _STREAM)
        x, t, w, p, rank = (table.column(c).to_numpy() for c in ("x", "t", "w", "p", "rank"))
        is_value = table.column("x").is_valid().to_numpy()
        asks, found = _answers(np.cumsum(new), t, x, is_value, w, p, rank)
        out = table.select(["k", "t", "w", "p", "weight"]).take(pa.array(asks))
        yield from out.append_column("value", pa.array(found)).combine_chunks().to_batches()

    return rows.mapInArrow(_by_streams(_STREAM, solve), f"k {kind}, t long, w long, p double, weight double, value double")


def signed_select(pieces: np.ndarray, signs: np.ndarray, start: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple:
    """(piece, rank in it) of the 0-based ``rank`` after the first ``at`` events; ``start`` is what each piece holds before them.

    An event adds its sign to the count of its piece. As in a wavelet matrix, events are parted by one bit of the piece after
    another, and a question goes to the half that holds its rank.
    """
    bits = max(len(start) - 1, 1).bit_length()
    held = np.zeros((1 << bits) + 1, np.int64)
    held[1 : len(start) + 1] = start
    held = np.cumsum(held)
    held[len(start) + 1 :] = held[len(start)]
    found, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for bit in reversed(range(bits)):
        one = (pieces >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        low = np.concatenate([[0], np.cumsum(np.where(one, 0, signs))])
        count = held[found + (1 << bit)] - held[found] + low[at] - low[first]
        up = rank >= count
        rank = np.where(up, rank - count, rank)
        found += up.astype(np.int64) << bit
        first, at = (np.where(up, zeros[-1] + a - zeros[a], zeros[a]) for a in (first, at))
        pieces, signs = (np.concatenate([a[~one], a[one]]) for a in (pieces, signs))
    return found, rank


def _led(t: np.ndarray, kind: np.ndarray, piece: np.ndarray, n: np.ndarray, lengths: list, levels: list):
    """Per window and level: (instants, w, p, weight, piece, rank) of what is asked in a chunk.

    Rows of kind 0 are the instants and the values that enter, of kind j those that leave the j-th window, of kind -j what
    its pieces hold before the chunk.
    """
    instants = np.unique(t[kind == 0])
    width = int(piece.max(initial=0)) + 1
    for j, w in enumerate(lengths, 1):
        before = kind == -j
        start = np.bincount(piece[before], n[before], width).astype(np.int64)
        events = np.flatnonzero((kind == 0) & (piece >= 0) | (kind == j))
        events = events[np.argsort(t[events], kind="stable")]
        signs = np.where(kind[events] == 0, n[events], -n[events])
        # a question comes before what happens at its instant
        at = np.searchsorted(t[events], instants)
        total = start.sum() + np.concatenate([[0], np.cumsum(signs)])[at]
        some = total > 0
        when, at, total = instants[some], at[some], total[some]
        for p in levels:
            spot = p * (total - 1)
            low = np.floor(spot).astype(np.int64)
            share = spot - low
            two = np.flatnonzero(share > 0)
            places, ranks = signed_select(
                piece[events], signs, start, np.concatenate([at, at[two]]), np.concatenate([low, low[two] + 1])
            )
            here, there = places[: len(at)], places[len(at) :]
            # both neighbours of the rank mostly lie in one piece, and are one question there
            apart = here[two] != there
            weight = np.ones(len(at))
            weight[two[apart]] = 1 - share[two[apart]]
            rank = ranks[: len(at)].astype(float)
            rank[two[~apart]] += share[two[~apart]]
            yield when, w, p, weight, here, rank
            other = two[apart]
            yield when[other], w, p, share[other], there[apart], ranks[len(at) :][apart].astype(float)


def _carried(events: DataFrame, plan, windows: int) -> DataFrame:
    """(k, t, piece, n, kind, __chunk): what each piece holds for each window when a chunk begins, kind -j for the j-th."""
    net = events.where("piece >= 0").groupBy("k", "__chunk", "kind", "piece").agg(F.sum("n").alias("n"))
    net = net.selectExpr("k", "__chunk", "piece", f"explode(IF(kind = 0, sequence(1, {windows}), array(kind))) AS j", "IF(kind = 0, n, -n) AS d")
    net = net.groupBy("k", "__chunk", "j", "piece").agg(F.sum("d").alias("d"))
    order = "OVER (PARTITION BY k, j, piece ORDER BY __chunk)"
    net = net.selectExpr("k", "j", "piece", "__chunk AS c", f"sum(d) {order} AS n", f"lead(__chunk) {order} AS upto")
    ends = plan.gates().groupBy(F.col("__hot")).agg(F.max("__chunk").alias("end"))
    net = net.join(F.broadcast(ends), F.expr("k = __hot")).where("n <> 0 AND c < end")
    return net.selectExpr("k", "0L AS t", "piece", "n", "-j AS kind", "explode(sequence(c + 1, coalesce(upto, end))) AS __chunk")


def _pieces(base: DataFrame, long: DataFrame, lengths: list, levels: list, limit: int, policy: ScalePolicy) -> tuple:
    """The keys in ``long`` cut by value: (their pieces' values, the pieces' questions, answers found at a cut)."""
    parts = f"cast(least({PARTS}, greatest({CUTS}, 2 * ceil(n / {limit}))) AS int)"
    wanted = long.selectExpr("hk", f"{parts} AS parts")
    found = [r["parts"] for r in wanted.select("parts").distinct().collect()]
    size = F.coalesce(*[F.when(F.col("parts") == n, F.lit(_size(n))) for n in found])
    usable = base.where("x IS NOT NULL AND NOT isnan(x)")
    joined = usable.join(F.broadcast(wanted.withColumn("size", size)), F.expr("k = hk"))
    cuts = _sketched(joined, ["k"], "x", sorted({_size(n) for n in found}))
    cuts = F.broadcast(_stored(cuts.select(F.col("k").alias("ck"), F.sort_array(F.array_distinct("q")).alias("cuts")), "cuts"))
    steps = ", ".join(str(1 << b) for b in reversed(range(PARTS.bit_length())))
    below = f"aggregate(array({steps}), 0, (pos, step) -> IF(get(cuts, pos + step - 1) < x, pos + step, pos))"
    # pieces 0, 2, 4, .. lie between the cuts, 1, 3, .. are the cuts themselves; -1 are instants without a value
    hot = base.join(cuts, F.expr("k = ck")).selectExpr("k", "t", "x", "cuts", f"IF(x IS NULL OR isnan(x), NULL, {below}) AS below")
    hot = _stored(hot.selectExpr("k", "t", "x", "coalesce(2 * below + IF(get(cuts, below) = x, 1, 0), -1) AS piece"), "hot")
    grouped = hot.groupBy("k", "t", "piece").agg(F.sum(F.expr("IF(piece < 0, 0L, 1L)")).alias("n")).withColumn("i", F.lit(0).cast("long"))
    grouped = _stored(grouped, "grouped")
    rows = grouped.count()
    # an instant is never cut: it has at most one row for each piece
    chunk = ScalePolicy(max(limit, CHUNK_SHARE * max(found)), policy.max_chunks)
    plan = plan_chunks(grouped, "k", "t", "i", chunk, rows)
    ends = F.broadcast(grouped.groupBy(F.col("k").alias("ek")).agg(F.max("t").alias("last")))
    kinds = ", ".join(f"struct({j} AS kind, {w}L AS shift)" for j, w in enumerate([0, *lengths]))
    events = grouped.join(ends, F.expr("k = ek")).selectExpr("k", "t", "piece", "n", "i", "last", f"explode(array({kinds})) AS e")
    # nobody asks for what leaves after the last row
    events = events.where("e.kind = 0 OR piece >= 0 AND t + e.shift < last")
    events = plan.attach(events.selectExpr("k", "t + e.shift AS t", "piece", "n", "e.kind AS kind", "i"), "k", "t", "i").drop("i")
    if not plan.empty:
        events = events.unionByName(_carried(events, plan, len(lengths)))
    tasks = max(2, -(-rows * (1 + len(lengths)) // TASK_ROWS))
    events = events.repartition(tasks, "k", "__chunk").sortWithinPartitions("k", "__chunk")
    kind = events.schema["k"].dataType.simpleString()

    def lead(table: pa.Table):
        edges = [0, *np.flatnonzero(_changes(table, ["k", "__chunk"])).tolist(), table.num_rows]
        arrays = [table.column(c).to_numpy() for c in ("t", "kind", "piece", "n")]
        for a, b in zip(edges, edges[1:]):
            for t, w, p, weight, piece, rank in _led(*(x[a:b] for x in arrays), lengths, levels):
                key = table.column("k").take(pa.array(np.full(len(t), a))).combine_chunks()
                columns = [key, t, np.full(len(t), w, np.int64), np.full(len(t), p), weight, piece.astype(np.int32), rank]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "t", "w", "p", "weight", "piece", "rank"])

    schema = f"k {kind}, t long, w long, p double, weight double, piece int, rank double"
    told = _stored(events.mapInArrow(_by_streams(["k", "__chunk"], lead), schema), "told")
    answered = told.where("piece % 2 = 1").join(cuts, F.expr("k = ck"))
    answered = answered.selectExpr("k", "t", "w", "p", "weight", "cuts[cast((piece - 1) / 2 AS int)] AS value")
    node = "concat('/', cast(piece AS string)) AS node"
    asks = told.where("piece % 2 = 0").selectExpr("k", node, "t", "w", "p", "rank", "weight")
    return hot.where("piece >= 0 AND piece % 2 = 0").selectExpr("k", node, "t", "x"), asks, answered


def _divided(values: DataFrame, asks: DataFrame, policy: ScalePolicy) -> tuple:
    """Long streams cut by value: (their pieces' values, the pieces' questions, answers found at a cut)."""
    grid = [j / (CUTS + 1) for j in range(1, CUTS + 1)]
    cuts = values.groupBy(F.col("k").alias("ck"), F.col("node").alias("cn")).agg(
        F.sort_array(F.array_distinct(F.percentile_approx("x", grid, 10_000))).alias("cuts")
    )
    cuts = F.broadcast(_stored(cuts, "cuts"))  # one row per long stream
    same = F.expr("k = ck AND node = cn")
    # pieces 0, 2, 4, .. lie between the cuts, 1, 3, .. are the cuts themselves
    piece = F.expr("2 * size(filter(cuts, c -> c < x)) + IF(array_contains(cuts, x), 1, 0)")
    values = values.join(cuts, same).withColumn("piece", piece)
    lengths = [r["w"] for r in asks.select("w").distinct().collect()]
    events = values.select(
        "k", "node", F.explode(F.array(*[F.lit(w).cast("long") for w in lengths])).alias("w"), "t", "piece",
    ).selectExpr("k", "node", "w", "inline(array(struct(t AS t, 1L AS d), struct(t + w AS t, -1L AS d)))", "piece")
    asked = asks.selectExpr("k", "node", "w", "t", "0L AS d", "-1 AS piece", "p", "rank", "weight", "0L AS i")
    both = asked.unionByName(events.selectExpr("*", "1L AS i"), allowMissingColumns=True)
    # a window's questions at an instant come before what happens at it
    both = both.withColumn("s", F.struct("k", "node", "w"))
    sums = {f"n{j}": f"IF(piece = {j}, d, 0L)" for j in range(2 * CUTS + 1)}
    told = ordered_sums(both, "s", "t", "i", sums, plan_chunks(both, "s", "t", "i", policy)).where("piece = -1")
    counts = F.array(*sums)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)
    told = told.select("k", "node", "w", "t", "p", "rank", "weight", counts.alias("counts"), total.alias("total")).where("total > 0")
    told = told.withColumn("spot", F.expr("IF(rank >= 0, rank, p * (total - 1))"))
    pairs = "filter(array(struct(floor(spot) AS r, 1 - (spot - floor(spot)) AS share), struct(ceil(spot) AS r, spot - floor(spot) AS share)), x -> x.share > 0)"
    told = told.selectExpr("k", "node", "w", "t", "p", "weight", "counts", f"inline({pairs})")
    # from piece to piece until the rank lies in one
    step = "IF(a.at >= 0, a, IF(a.r < c, struct(a.r AS r, a.j AS j, a.j AS at), struct(a.r - c AS r, a.j + 1 AS j, -1 AS at)))"
    place = f"aggregate(counts, struct(cast(r AS bigint) AS r, 0 AS j, -1 AS at), (a, c) -> {step})"
    told = told.withColumn("place", F.expr(place)).withColumn("weight", F.expr("weight * share"))
    told = _stored(told.select("k", "node", "w", "t", "p", "weight", "place"), "told")
    found = told.where("place.at % 2 = 1").join(cuts, same)
    found = found.selectExpr("k", "t", "w", "p", "weight", "cuts[cast((place.at - 1) / 2 AS int)] AS value")
    deeper = "concat(node, '/', cast({} AS string)) AS node"
    asks = told.where("place.at % 2 = 0").selectExpr("k", deeper.format("place.at"), "t", "w", "p", "cast(place.r AS double) AS rank", "weight")
    values = values.where("piece % 2 = 0").selectExpr("k", deeper.format("piece"), "t", "x")
    return values, asks, found


def rolling_quantiles(
    df: DataFrame,
    key: str,
    value: str,
    t: str,
    windows,
    probs: dict,
    policy: ScalePolicy = DEFAULT_POLICY,
    keep=None,
) -> DataFrame:
    """``df`` with ``{prefix}_{window}`` for each prefix and probability in ``probs``, e.g. ``{"amount_median": 0.5}``.

    Quantiles are interpolated linearly. Null and NaN values are skipped; the result is null where none is in the window.
    """
    windows = [(window_label(w), window_micros(w)) for w in windows]
    keep = list(keep or df.columns)
    base = df.selectExpr(f"{quoted(key)} AS k", f"{quoted(t)} AS t", f"cast({quoted(value)} AS double) AS x").where("k IS NOT NULL AND t IS NOT NULL")
    values = base.where("x IS NOT NULL AND NOT isnan(x)").selectExpr("k", "'' AS node", "t", "x")
    lengths = ", ".join(f"{w}L" for _, w in windows)
    levels = ", ".join(f"{p}D" for p in sorted(set(probs.values())))
    asks = base.select("k", "t").distinct().selectExpr("k", "t", f"explode(array({lengths})) AS w")
    asks = asks.selectExpr("k", "'' AS node", "t", "w", f"explode(array({levels})) AS p", "-1D AS rank", "1D AS weight")
    total = base.count()
    limit, answers = policy.chunk_limit(total), []
    tasks = max(2, -(-total * (1 + len(windows) * len(set(probs.values()))) // TASK_ROWS))
    long = _stored(values.groupBy(F.col("k").alias("hk")).agg(F.count("*").alias("n")).where(F.col("n") > limit), "long")
    if long.limit(1).count():
        # at most one key for each ``limit`` rows
        short_values, short_asks = (d.join(F.broadcast(long), F.expr("k = hk"), "left_anti") for d in (values, asks))
        answers.append(_solved(short_values, short_asks, limit, tasks))
        values, asks, found = _pieces(base, long, [w for _, w in windows], sorted(set(probs.values())), limit, policy)
        answers.append(found)
        limit = max(limit, PIECE_ROWS)
    while True:
        # at most one stream for each ``limit`` rows
        long = values.groupBy(F.col("k").alias("hk"), F.col("node").alias("hn")).agg(F.count("*").alias("n"))
        long = _stored(long.where(F.col("n") > limit).drop("n"), "long")
        if not long.limit(1).count():
            answers.append(_solved(values, asks, limit, tasks))
            break
        same = F.expr("k = hk AND node = hn")
        short_values, short_asks = (d.join(F.broadcast(long), same, "left_anti") for d in (values, asks))
        answers.append(_solved(short_values, short_asks, limit, tasks))
        cut_values, cut_asks, found = _divided(*(d.join(F.broadcast(long), same, "left_semi") for d in (values, asks)), policy)
        answers.append(found)
        values, asks = _stored(cut_values, "values"), _stored(cut_asks, "asks")
    told = answers[0]
    for more in answers[1:]:
        told = told.unionByName(more)
    columns = [
        F.expr(f"sum(IF(w = {w}L AND p = {p}D, value * weight, NULL))").alias(f"q{n}_{m}")
        for n, (_, w) in enumerate(windows)
        for m, p in enumerate(probs.values())
    ]
    told = told.groupBy("k", "t").agg(*columns)
    named = [
        f"q.q{n}_{m} AS {quoted(f'{prefix}_{label}')}" for n, (label, _) in enumerate(windows) for m, prefix in enumerate(probs)
    ]
    rows = df.alias("d").join(told.alias("q"), F.expr(f"d.{quoted(key)} = q.k AND d.{quoted(t)} = q.t"), "left")
    return rows.selectExpr(*[f"d.{quoted(c)}" for c in keep], *named)
