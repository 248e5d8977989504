"""Gain curves, and the threshold of gain that hands out a given number of executors.

Handing out executors one at a time to the component with the largest gain is a
merge of the components' gain lists by their heads. A gain behind a smaller one
is released only together with it, so each list may be read at its prefix
minimum (its *head*), and the merge takes exactly the steps with the largest
heads. So an allocation is a threshold: every step whose head lies above it is
taken, and of those at it as many as are left, by name of the component.

A component keeps its heads as one falling array. The threshold of every job is
found by a search of many ways: each round counts, per component by bisection
and added up per job before the shuffle, how many steps lie above each of a few
candidates. Only the steps between the last two candidates become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import queueing as q
from tidegauge.session import written

# Gains are compared at so many significant digits, so equal components tie and go by name at any scale.
GAIN_DIGITS = 12
# Fixed value: a gain must lie above this to be taken.
GAIN_FLOOR = -1.0
#: Executor counts from which a rate counts as broken.
LONGEST_CURVE = 1_000_000
#: Candidates per round of the search.
WAYS = 16
#: Rounds at most; any bracket that is left is unfolded as it is. A double has not so many digits.
MOST_ROUNDS = 24
#: Steps of a job that are unfolded without a further round: so many per component, and so many at all.
PER_COMPONENT, AT_ALL = 2, 256
# Candidates lie evenly on a scale that is linear within this distance of zero and logarithmic beyond.
_SMALLEST = 1e-20
# Gains of GAIN_DIGITS digits that are closer than this on the scale are equal.
_SAME = 1e-12
_CHUNK = 64


def significant(gain: Column) -> Column:
    """``gain`` at :data:`GAIN_DIGITS` significant digits; what is not finite stays as it is."""
    size = F.abs(gain)
    scale = F.pow(F.lit(10.0), GAIN_DIGITS - 1 - F.floor(F.log10(size)))
    scaled = F.rint(gain * scale) / scale
    return F.when((size > 1e-290) & (size < 1e290), scaled).otherwise(gain)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_min(values: Column, depth: int = 2) -> Column:
    """Minimum of each prefix of an array without NULLs, in a few steps per element.

    Chunks are reduced first, their minima are treated the same way, and each
    element looks at the chunks before its own and at its own up to itself.
    """
    def chunked(x: Column) -> Column:
        chunks = F.ceil(F.size(x) / _CHUNK).cast("int")
        lowest = F.transform(
            F.when(chunks > 0, F.sequence(F.lit(0), chunks - 1)).otherwise(F.expr("cast(array() as array<int>)")),
            lambda j: F.array_min(F.slice(x, j * _CHUNK + 1, _CHUNK)),
        )
        return _bound(running_min(lowest, depth - 1), lambda before: F.transform(x, lambda _, i: F.least(
            F.get(before, F.floor(i / _CHUNK).cast("int") - 1),
            F.array_min(F.slice(x, (F.floor(i / _CHUNK) * _CHUNK).cast("int") + 1, i % _CHUNK + 1)),
        )))

    def plain(x: Column) -> Column:
        return F.transform(x, lambda _, i: F.array_min(F.slice(x, 1, i + 1)))

    return _bound(values, chunked if depth else plain)


def _no_doubles() -> Column:
    return F.expr("cast(array() as array<double>)")


def gain_curves(nodes: DataFrame, room: Column, models: Sequence[str] = ("mmk",)) -> DataFrame:
    """Add the curve of each node from its smallest stable count over ``room`` further executors, as arrays.

    ``sojourn_<m>`` has the times at every count and ``head_<m>`` the heads of
    the usable steps. Both are empty without room, and for a node whose counts
    reach :data:`LONGEST_CURVE`: its rate, or its limit, counts as broken.
    """
    lam, mu = F.col("lam"), F.col("mu")
    floors = nodes.withColumn("min_executors", q.min_servers(lam, mu)).withColumn("_room", room.cast("bigint"))
    rest = floors.columns
    usable = (F.col("_room") >= 0) & ~broken(F.col("min_executors"), F.col("_room"))
    top = F.least(F.col("min_executors") + F.col("_room"), F.lit(LONGEST_CURVE)).cast("int")
    curves = floors.withColumn(
        "_blocked", F.when(usable, q.erlang_b_curve(lam / mu, F.col("min_executors"), top)).otherwise(_no_doubles())
    )

    def sojourn(model: str) -> Column:
        def at(blocked: Column, i: Column) -> Column:
            k = F.col("min_executors") + i
            return q.sojourn(model, lam, mu, k, F.col("ca2"), F.col("cs2"), q.wait_from_blocking(lam, mu, k, blocked))

        return F.transform("_blocked", at)

    curves = curves.select(*rest, *[sojourn(m).alias(f"sojourn_{m}") for m in models])

    def gains(model: str) -> Column:
        times = F.col(f"sojourn_{model}")
        steps = F.size(times) - 1
        each = F.transform(
            F.when((lam > 0) & (steps > 0), F.sequence(F.lit(0), steps - 1)).otherwise(F.expr("cast(array() as array<int>)")),
            lambda i: significant((F.get(times, i) - F.get(times, i + 1)) * F.col("ratio")),
        )
        # what cannot be taken ends the list: it lies at the floor, and so does every head behind it
        return F.transform(each, lambda g: F.when(g.isNotNull() & ~F.isnan(g) & (g > GAIN_FLOOR), g).otherwise(F.lit(GAIN_FLOOR)))

    curves = curves.withColumns({f"_gain_{m}": gains(m) for m in models})
    curves = curves.withColumns({f"_low_{m}": running_min(F.col(f"_gain_{m}")) for m in models})
    curves = curves.withColumns({f"head_{m}": F.filter(f"_low_{m}", lambda h: h > GAIN_FLOOR) for m in models})
    return curves.drop("_room", *[f"{c}_{m}" for c in ("_gain", "_low") for m in models])


def broken(min_executors: Column, room: Column, longest: int = LONGEST_CURVE) -> Column:
    """Whether a node's counts, from the smallest stable one over ``room``, are too many for a curve; so is an unknown one."""
    highest = min_executors.cast("bigint") + F.greatest(room, F.lit(0))
    return F.coalesce(highest >= longest, F.lit(True))


def count_above(heads: Column, threshold: Column) -> Column:
    """How many of the falling ``heads`` lie above ``threshold``, by bisection."""
    powers = F.array(*[F.lit(1 << b) for b in range(LONGEST_CURVE.bit_length() - 1, -1, -1)])
    return F.aggregate(
        powers, F.lit(0),
        lambda n, step: F.when((n + step <= F.size(heads)) & (F.get(heads, n + step - 1) > threshold), n + step).otherwise(n),
    )


def _scaled(t: Column) -> Column:
    return F.signum(t) * F.log2(1 + F.abs(t) / _SMALLEST)


def _unscaled(y: Column) -> Column:
    return F.signum(y) * (F.pow(F.lit(2.0), F.abs(y)) - 1) * _SMALLEST


def _saved(times: Column, steps: Column) -> Column:
    """What ``steps`` steps take off the end-to-end time."""
    return F.when(steps > 0, (F.get(times, F.lit(0)) - F.get(times, steps)) * F.col("ratio")).otherwise(F.lit(0.0))


def _heads(models: Sequence[str]) -> Column:
    chosen = F.col(f"head_{models[0]}")
    for m in models[1:]:
        chosen = F.when(F.col("model") == m, F.col(f"head_{m}")).otherwise(chosen)
    return chosen


def _times(models: Sequence[str]) -> Column:
    chosen = F.col(f"sojourn_{models[0]}")
    for m in models[1:]:
        chosen = F.when(F.col("model") == m, F.col(f"sojourn_{m}")).otherwise(chosen)
    return chosen


def _enough(n: Column, saved: Column) -> Column:
    """Whether a goal is met: so many steps, or the time that is left within the target."""
    return F.when(
        F.col("steps").isNotNull(), n >= F.col("steps")
    ).otherwise((F.col("floor_s") - saved) * F.col("adjust") <= F.col("target_s"))


def _point(t: Column, n: Column, saved: Column) -> Column:
    return F.struct(t.cast("double").alias("t"), n.cast("bigint").alias("n"), saved.cast("double").alias("saved"))


def _just_below(head: Column) -> Column:
    """Below ``head`` and above every smaller one of :data:`GAIN_DIGITS` digits."""
    return F.when(head == 0, F.lit(-_SMALLEST * _SMALLEST)).otherwise(head - F.abs(head) * 4e-13)


def _open() -> Column:
    """Whether the bracket of a goal still holds too many steps, of more than one head."""
    rows = F.col("low.n") - F.col("high.n")
    apart = _scaled(F.col("high.t")) - _scaled(F.col("low.t"))
    return (rows > PER_COMPONENT * F.col("components") + AT_ALL) & (apart > _SAME)


def brackets(curves: DataFrame, goals: DataFrame, scope: Sequence[str], models: Sequence[str]) -> DataFrame:
    """The bracket of every goal, ``high`` and ``low`` as ``(t, n, saved)``: threshold, steps above it, what they save.

    Steps above ``high.t`` do not meet the goal, those above ``low.t`` do.
    Where nothing has to be searched both are equal: all steps or none.
    ``goals`` has, per scope and ``goal``, its ``model`` and either ``steps`` or
    ``floor_s, adjust, target_s``.
    """
    scope = list(scope)
    heads, times = _heads(models), _times(models)
    goal_columns = [c for c in goals.columns if c not in scope]
    size = F.size(heads)
    ends = curves.join(goals, scope).groupBy(*scope, *goal_columns).agg(
        F.count(F.lit(1)).alias("components"), F.max(F.get(heads, F.lit(0))).alias("_first"),
        F.min(F.get(heads, size - 1)).alias("_last"),
        F.sum(size).alias("_n"), F.sum(_saved(times, size)).alias("_saved"),
    )
    none = _point(F.coalesce("_first", F.lit(GAIN_FLOOR)), F.lit(0), F.lit(0.0))
    every = _point(F.coalesce(_just_below(F.col("_last")), F.lit(GAIN_FLOOR)), F.col("_n"), F.col("_saved"))
    met = F.coalesce(_enough(F.lit(0), F.lit(0.0)), F.lit(True))
    state = ends.select(
        *scope, *goal_columns, "components",
        F.when(met | _enough(F.col("_n"), F.col("_saved")), none).otherwise(every).alias("high"),
        F.when(met, none).otherwise(every).alias("low"),
    )
    state = written(state, "brackets")
    for _ in range(MOST_ROUNDS):
        wide = state.filter(_open())
        if wide.isEmpty():
            break
        state = written(state.filter(~_open()).unionByName(_narrowed(curves, wide, scope, heads, times)), "brackets")
    return state


def _narrowed(curves: DataFrame, wide: DataFrame, scope: Sequence[str], heads: Column, times: Column) -> DataFrame:
    """One round: the two candidates next to the threshold become the new bracket.

    Both are moved to heads that there are, as far as no step lies between, so
    a bracket that holds one head only is seen at once, whatever its scale.
    """
    columns = wide.columns
    top, bottom = _scaled(F.col("high.t")), _scaled(F.col("low.t"))
    tried = wide.withColumn("_tried", F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(WAYS)), lambda i: _unscaled(top + (bottom - top) * i / F.lit(WAYS + 1.0))),
        lambda t: (t < F.col("high.t")) & (t > F.col("low.t")),
    ))
    narrow = curves.join(tried.select(*scope, "goal", "model", "_tried"), scope).withColumn("_heads", heads)
    counted = narrow.withColumn("_n", F.transform("_tried", lambda t: count_above(F.col("_heads"), t))).select(
        *scope, "goal", "_n", "_heads", F.transform("_n", lambda n: _saved(times, n)).alias("_saved")
    )
    at = [F.get("_n", F.lit(i)) for i in range(WAYS)]
    summed = counted.groupBy(*scope, "goal").agg(
        *[F.sum(n).alias(f"_n{i}") for i, n in enumerate(at)],
        *[F.sum(F.get("_saved", F.lit(i))).alias(f"_s{i}") for i in range(WAYS)],
        *[F.max(F.get("_heads", n)).alias(f"_below{i}") for i, n in enumerate(at)],
        *[F.min(F.get("_heads", n - 1)).alias(f"_above{i}") for i, n in enumerate(at)],
    )
    points = F.array(*[F.struct(
        _point(F.coalesce(f"_below{i}", F.get("_tried", F.lit(i))), F.col(f"_n{i}"), F.col(f"_s{i}")).alias("high"),
        _point(F.coalesce(_just_below(F.col(f"_above{i}")), F.get("_tried", F.lit(i))), F.col(f"_n{i}"), F.col(f"_s{i}")).alias("low"),
    ) for i in range(WAYS)])
    found = tried.join(summed, [*scope, "goal"]).withColumn("_points", F.filter(points, lambda p: p["high"]["n"].isNotNull()))
    met = F.transform(F.filter("_points", lambda p: _enough(p["low"]["n"], p["low"]["saved"])), lambda p: p["low"])
    unmet = F.transform(F.filter("_points", lambda p: ~_enough(p["high"]["n"], p["high"]["saved"])), lambda p: p["high"])
    return found.withColumns({
        "high": F.array_min(F.concat(F.array("high"), unmet)), "low": F.array_max(F.concat(F.array("low"), met)),
    }).select(*columns)


def bracket_steps(curves: DataFrame, found: DataFrame, scope: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Rows of the steps inside the brackets: component, ``head``, ``weight`` (equal steps as one row) and ``gain``.

    Every component and goal has a row at least, with ``base`` as its steps above the bracket.
    """
    heads, times = _heads(models), _times(models)
    joined = curves.join(found, list(scope)).withColumns({
        "base": count_above(heads, F.col("high.t")), "_end": count_above(heads, F.col("low.t")),
    })
    # one head only: its steps are a run, of which a count is taken
    alike = F.col("steps").isNotNull() & (_scaled(F.col("high.t")) - _scaled(F.col("low.t")) <= _SAME)
    width = F.col("_end") - F.col("base")
    first = F.when(width > 0, F.when(alike, F.array("base")).otherwise(F.sequence("base", F.col("_end") - 1)))
    step = F.col("step")
    gain = (F.get(times, step) - F.get(times, step + 1)) * F.col("ratio")
    kept = [c for c in joined.columns if not c.startswith(("head_", "sojourn_")) and c != "_end"]
    return joined.withColumn("_width", F.when(alike, width).otherwise(1)).select(
        "*", F.explode_outer(first).alias("step")
    ).select(
        *kept, "step", F.get(heads, step).alias("head"), F.when(step.isNotNull(), F.col("_width")).otherwise(0).alias("weight"),
        F.coalesce(gain, F.lit(0.0)).alias("gain"),
    )


def steps_taken(curves: DataFrame, goals: DataFrame, scope: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Per scope, goal and component: ``taken`` steps, ``all_taken`` over the scope, and whether the goal is ``met``.

    Other columns of both inputs are kept.

    Curves and goals are read in every round: hand in written tables.
    """
    scope = list(scope)
    found = brackets(curves, goals, scope, models).withColumn("met", _enough(F.col("low.n"), F.col("low.saved")))
    rows = bracket_steps(curves, found, scope, models)
    turn = Window.partitionBy(*scope, "goal").orderBy(F.desc_nulls_last("head"), "component", "step")
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("weight").over(before), F.lit(0))
    so_far = F.col("high.saved") + F.coalesce(F.sum("gain").over(before), F.lit(0.0))
    left = F.greatest(F.col("steps") - F.col("high.n") - earlier, F.lit(0))
    rows = rows.withColumns({"_left": left, "_so_far": so_far})
    take = F.when(F.col("steps").isNotNull(), F.least("weight", "_left")).when(
        _enough(F.lit(0), F.col("_so_far")), F.lit(0)
    ).otherwise(F.col("weight"))
    rows = rows.withColumn("_take", take)
    same = [c for c in rows.columns if c not in (*scope, "goal", "component", "step", "head", "weight", "gain", "_left", "_so_far", "_take", "high", "low")]
    whole = Window.partitionBy(*scope, "goal")
    return (
        rows.withColumn("_all", F.col("high.n") + F.sum("_take").over(whole))
        .groupBy(*scope, "goal", "component")
        .agg(*[F.first(c).alias(c) for c in same], F.sum("_take").alias("_extra"), F.first("_all").alias("all_taken"))
        .withColumn("taken", (F.col("base") + F.col("_extra")).cast("int"))
        .drop("base", "_extra", "components")
    )
